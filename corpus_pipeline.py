"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import new_folder, table, word_count
from strandline.llm.line_dedup import repeated_lines, without_lines
from strandline.llm.minhash import near_duplicates
from strandline.llm.mixing import mix, repeated
from strandline.llm.packing import pack
from strandline.llm.quality import judged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return judged(docs, table(spark, sf_dir, "labels")).where("__q_kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines alike the first stays; documents left without words go."""
    return without_lines(docs, repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__n_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__n_id")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return repeated(docs, mix(sized))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixture", mixture), ("packing", packing)]

#: SQL can't express the signatures and the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Operators as SQL over named frames.

An operator is a SELECT whose {names} stand for its input frames. Called with DataFrames it returns a DataFrame, so Catalyst sees one
plan over all operators that a query combines. The same text, with the few words in which dialects differ written as @macros,
renders to DuckDB for the correctness gate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .folders import cut

#: Words in which the dialects differ: Spark's form, DuckDB's form; {0}, {1}... are arguments.
MACROS = {
    "unix": ("unix_timestamp({0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "isum": ("CAST(sum({0}) AS BIGINT)", "CAST(sum({0}) AS BIGINT)"),
    "joined": ("array_join(array_sort(collect_set({0})), ',')", "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER (WHERE {0} IS NOT NULL)), ','), '')"),
    "quantile": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "div": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "dow": ("(dayofweek({0}) - 1)", "dayofweek({0})"),
    "date": ("to_date({0})", "CAST({0} AS DATE)"),
    "days": ("datediff({0}, {1})", "date_diff('day', {1}, {0})"),
    "each": ("LATERAL explode({0})", "LATERAL unnest({0})"),
    "each_at": ("LATERAL posexplode({0}) AS {1}(pos, x)", "LATERAL (SELECT unnest(range(len({0}))) AS pos, unnest({0}) AS x) AS {1}"),
    "extract_all": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1})"),
    "replace_all": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "matches": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "hours_before": ("timestampadd(HOUR, -CAST({1} AS INT), {0})", "({0} - to_hours(CAST({1} AS BIGINT)))"),
    "minutes_after": ("timestampadd(MINUTE, CAST({1} AS INT), {0})", "({0} + to_minutes(CAST({1} AS BIGINT)))"),
    "time": ("TIMESTAMP_NTZ'{0}'", "TIMESTAMP '{0}'"),
    "sha256": ("sha2({0}, 256)", "sha256({0})"),
    "week": ("CAST(date_trunc('week', {0}) AS DATE)", "CAST(date_trunc('week', {0}) AS DATE)"),
    "distinct_words": ("size(array_distinct({0}))", "len(list_distinct({0}))"),
    "size": ("size({0})", "len({0})"),
    "common": ("size(array_intersect({0}, {1}))", "len(list_intersect({0}, {1}))"),
    "set": ("array_sort(collect_set({0}))", "list_sort(list(DISTINCT {0}))"),
    "str": ("CAST({0} AS STRING)", "CAST({0} AS VARCHAR)"),
    "grid": ("explode(sequence({0}, {1}))", "unnest(range({0}, {1} + 1))"),
    "minus": ("array_except({0}, {1})", "list_filter({0}, lambda x: NOT list_contains({1}, x))"),
    "count_if": ("count_if({0})", "CAST(count(*) FILTER (WHERE {0}) AS BIGINT)"),
    "trunc": ("CAST(date_trunc({0}, {1}) AS TIMESTAMP_NTZ)", "date_trunc({0}, {1})"),
    "json": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "bits": ("bit_count({0})", "bit_count({0})"),
    # values in the order of another, as one text; and the first of them
    "in_order": ("array_join(transform(array_sort(collect_list(struct({1} AS o, {0} AS v))), x -> CAST(x.v AS STRING)), ',')", "string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {1}, {0})"),
    "first_by": ("min_by({0}, struct({1}, {0}))", "(list({0} ORDER BY {1}, {0}))[1]"),
    "words": ("split({0}, ' ')", "string_split({0}, ' ')"),
    "without_word": ("array_join(filter({0}, (x, i) -> i <> {1}), ' ')", "array_to_string(list_filter({0}, lambda x, i: i <> {1} + 1), ' ')"),
    "element": ("element_at({0}, CAST({1} AS INT))", "({0})[{1}]"),
    "letters": ("regexp_replace({0}, '[^\\\\p{{L}}]', '')", "regexp_replace({0}, '[^\\p{{L}}]', '', 'g')"),
    "spoken": ("regexp_replace({0}, '[^\\\\p{{L}}\\\\p{{N}} ]+', ' ')", "regexp_replace({0}, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g')"),
    "bucket_of": ("CAST(width_bucket({0}, {1}, {2}, {3}) AS BIGINT)", "CAST(CASE WHEN {0} < {1} THEN 0 WHEN {0} >= {2} THEN {3} + 1 ELSE floor(({0} - {1}) * {3} / ({2} - {1})) + 1 END AS BIGINT)"),
    "num": ("try_cast({0} AS BIGINT)", "TRY_CAST({0} AS BIGINT)"),
    "re": ("r'{0}'", "'{0}'"),
    "no_text": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
    "no_time": ("CAST(NULL AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP)"),
    "seconds_before": ("timestampadd(SECOND, -CAST({1} AS INT), {0})", "({0} - to_seconds(CAST({1} AS BIGINT)))"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens at at, and the place after its end; brackets and quotes nest."""
    out, depth, begin, quoted = [], 0, at + 1, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[begin:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"open bracket in {text[at : at + 60]!r}")


def expanded(text: str, dialect: int) -> str:
    while m := re.search(r"@(\w+)\(", text):
        arguments, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + MACROS[m[1]][dialect].format(*arguments) + text[end:]
    return text


@dataclass(frozen=True)
class Operator:
    """name, what it returns, and its SELECT; inputs are the {names} in it.

    run: where Spark needs another way to the same rows, that way, over the frames reads instead of inputs; its result is a table.
    kept: several steps read it, so build makes it a table once.
    """

    name: str
    doc: str
    sql: str
    inputs: tuple[str, ...] = field(init=False)
    reads: tuple[str, ...] = ()
    run: Callable[..., DataFrame] | None = None
    kept: bool = False

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(dict.fromkeys(re.findall(r"\{([a-z_]\w*)\}", self.sql))))

    def __call__(self, **frames: DataFrame) -> DataFrame:
        if self.run and set(self.reads) <= set(frames):
            return self.run(**{k: frames[k] for k in self.reads})
        first = next(iter(frames.values()))
        text = re.sub(r"\{\{([a-z_]\w*)\}\}", r"{\1}", expanded(self.sql, 0).replace("{", "{{").replace("}", "}}"))  # braces of patterns stay
        return first.sparkSession.sql(text, **{k: frames[k] for k in self.inputs})

    def duckdb(self) -> str:
        return expanded(re.sub(r"\{([a-z_]\w*)\}", r"\1", self.sql), 1)


@dataclass(frozen=True)
class Computed:
    """An operator that SQL text can't express in Spark, such as a loop over frontiers; sql is DuckDB's form."""

    name: str
    doc: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    sql: str

    def __call__(self, **frames: DataFrame) -> DataFrame:
        return self.run(**{k: frames[k] for k in self.inputs})

    def duckdb(self) -> str:
        return self.sql


REGISTRY: dict[str, Operator | Computed] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def define(name: str, doc: str, sql: str, reads: tuple[str, ...] = (), run: Callable[..., DataFrame] | None = None, kept: bool = False) -> Operator:
    if name in REGISTRY or name in TABLES:
        raise ValueError(f"{name} is defined twice")
    REGISTRY[name] = out = Operator(name, doc, sql.strip(), reads, run, kept)
    return out


def define_computed(name: str, doc: str, inputs: tuple[str, ...], run: Callable[..., DataFrame], duckdb: str) -> Computed:
    if name in REGISTRY or name in TABLES:
        raise ValueError(f"{name} is defined twice")
    REGISTRY[name] = out = Computed(name, doc, inputs, run, duckdb.strip())
    return out


#: Tables of loops (ranks, hops, chains) and of kept operators, by application, folder and name: each is made once for the operators that read it.
_LOOPS: dict[tuple[str, str, str], DataFrame] = {}


def build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The operator's result over the tables in sf_dir, its inputs built first.

    What a Computed or kept operator gives over a folder is kept as a table for the application, so the folder's files must not
    change meanwhile.
    """
    made = {} if made is None else made
    own = REGISTRY.get(name)
    if name not in made and (getattr(own, "run", None) or getattr(own, "kept", False)):
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _LOOPS:
            found = own(**{k: build(spark, sf_dir, k, made) for k in getattr(own, "reads", ()) or own.inputs})
            _LOOPS[key] = cut(found) if getattr(own, "kept", False) else found
        made[name] = _LOOPS[key]
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            made[name] = own(**{k: build(spark, sf_dir, k, made) for k in own.inputs}) if own.inputs else spark.sql(expanded(own.sql, 0))
    return made[name]


def oracle(name: str) -> str:
    """One statement for DuckDB: the inputs as common table expressions, then the operator."""
    order: list[str] = []

    def visit(k: str):
        for i in REGISTRY[k].inputs:
            if i not in TABLES and i not in order:
                visit(i)
        order.append(k)

    visit(name)
    ctes = ",\n".join(f"{k} AS ({REGISTRY[k].duckdb()})" for k in order[:-1])
    own = REGISTRY[name].duckdb()
    if ctes and own.startswith("WITH"):
        own = f"SELECT * FROM ({own}) q"
    return (f"WITH {ctes}\n" if ctes else "") + own

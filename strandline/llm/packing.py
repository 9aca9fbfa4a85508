"""Best-fit packing: token ids cut into pieces, placed online into a bounded number of open sequences."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte_bpe_50k splits a text before it merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> token ids of a byte-level BPE file of the library tokenizers, as that gives them with add_special_tokens=False.

    The file's vocabulary numbers its merges in order, so tiktoken, which is several times faster, gives the same ids from it;
    a test holds the two against each other. Added tokens cut the text first, the longest at a place, and have their own ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in byte_of for c in token)}
    ordinary = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = {token["content"]: token["id"] for token in file.get("added_tokens") or ()}
    if any(token[flag] for token in file.get("added_tokens") or () for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens that look at their neighbours are not supported: {path}")
    if not added:
        return ordinary
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        first, *more = cut.split(text)
        ids = ordinary(first)
        for token, part in zip(more[::2], more[1::2], strict=True):
            ids.append(added[token])
            ids += ordinary(part)
        return ids

    return encode


class OpenSequences:
    """Online best fit over a fixed number of open sequences.

    A bit per amount of free space says whether an open sequence has it; the least amount that suffices is the lowest set bit
    above the need. When all places are taken, the fullest sequence (the lowest set bit) closes.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.made, self.bits = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset of a piece of at most size tokens."""
        fit = self.bits >> length
        if fit:
            free = (fit & -fit).bit_length() - 1 + length
            sequence = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.size, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.size - free

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of them size long, but for the first."""
    first = n % size or size
    yield 0, min(first, n)
    for start in range(first, n, size):
        yield start, size


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, open_sequences: int = 512, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text; others are dropped) into sequences of at most size tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids its ids as an array.
    A document is its text's ids and end_id; null text is empty, so has one token. Only documents longer than size are cut,
    into pieces of size with the shorter one first. Every task packs its own rows, in one pass without a shuffle: memory is a
    batch of texts and open_sequences places. Sequences that are still open at a task's end stay as full as they are. An
    empty table gives no rows; repeated rows and ids are packed each on their own.
    """
    if size < 1:
        raise ValueError("size must be positive")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        sequences = OpenSequences(size, open_sequences)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = array("I", encode(text.as_py()))
                ids.append(end_id)
                if sys.byteorder == "big":
                    ids.byteswap()
                view = memoryview(ids).cast("B")
                for k, (start, length) in enumerate(pieces(len(ids), size)):
                    sequence, offset = sequences.place(length)
                    crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                    yield (doc_id.as_py(), k, start, length, crc, base + sequence, offset) + ((ids[start : start + length].tolist(),) if with_ids else ())

        for batch in batches:
            found = rows(batch)
            while some := list(islice(found, 5000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spec = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, spec)

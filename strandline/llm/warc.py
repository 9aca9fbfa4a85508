"""WARC archives with a two-level capture index.

Captures are written as gzip members, one WARC record each. The index sorts lines by reversed-host URL key and compresses them
in blocks; each shard of it has a sparse directory of its blocks, and a table of shards stands above. A lookup finds the shard,
searches its directory, reads one block by range, then the records by range.

Tasks open files through pyarrow's file systems by URI, so the folder may be in any store those reach.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
VERSION, LINES, DATE = "WARC/1.1", 300, "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL: scheme, port, user and fragment left out, host in lower case without www."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").replace(" ", "%20").replace("\n", "%0A")
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return key.replace(" ", "%20").replace("\n", "%0A")


@dataclass(frozen=True)
class Archive:
    """Where an archive lies, and the table of its index's shards: shard, first, last, file, directory, blocks, captures."""

    folder: str
    shards: DataFrame


def _store(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def _record(kind: str, page_id, url: str, digest: str, payload: bytes, refers_to) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(r_page_id, r_digest, refers_to) of the pages whose payload of at least min_bytes another page with a larger page_id has too.

    Payloads are equal when SHA-256 and length are. One row per task and payload is shuffled for the winners, then ids only.
    A page_id may stand with several payloads, so a revisit is named by both.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= min_bytes)
    winners = keyed.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(winners, ["digest", "bytes"]).where("page_id < refers_to").select(F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()


def write_archive(pages: DataFrame, shards: int = 16, min_bytes: int = 0, level: int = 1) -> Archive:
    """Write a record per row of pages (page_id long, url, html; others are dropped) and the index, in the shared folder.

    Null html is an empty payload, a null url an empty one. Of equal payloads that of the largest page_id is the response and
    the others revisit it; rows that repeat the largest page_id are responses each. Rows of one page_id with different payloads
    are records each, and a revisit's stated digest tells which of them it means. A null page_id is a response. Each task
    writes its archive under a name of its own, so a task that runs twice leaves a file that no index names. An empty table
    gives an archive without shards.
    """
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    files, root = _store(folder)
    files.create_dir(root)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    again = written(revisits(pages, min_bytes), "revisits")
    digest = F.sha2(F.coalesce(pages["html"], F.lit("")).cast("binary"), 256)
    rows = pages.join(again, (pages["page_id"] == again["r_page_id"]) & (digest == again["r_digest"]), "left").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), "refers_to")
    def records(batches):
        store, root = _store(folder)
        name, at = f"captures-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            found = []
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = _gzip(_record("response" if refers_to is None else "revisit", page_id, url, digest, payload, refers_to), level)
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                found.append((reversed_host_key(url), page_id, name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE)
        if out:
            out.close()

    captures = written(rows.mapInArrow(records, "key string, page_id long, file string, offset long, length long"), "captures")
    lines = captures.repartitionByRange(shards, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return Archive(folder, written(lines.mapInArrow(lambda batches: _index(batches, folder), "shard string, first string, last string, file string, directory string, blocks long, captures long"), "shards"))


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One shard: a file of compressed blocks of LINES sorted lines, and a file with each block's first key and place."""
    store, root = _store(folder)
    shard, block, directory, at, n, first, last, out = uuid.uuid4().hex, [], [], 0, 0, None, None, None

    def close():
        nonlocal at, block
        data = zlib.compress("\n".join(x for _, x in block).encode())
        out.write(data)
        directory.append([block[0][0], at, len(data)])
        at, block = at + len(data), []

    for batch in batches:
        for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out = out or store.open_output_stream(f"{root}/index-{shard}.cdx", compression=None)
            first, last, n = key if first is None else first, key, n + 1
            block.append((key, f"{key} {json.dumps([page_id, file, offset, length])}"))
            if len(block) == LINES:
                close()
    if block:
        close()
    if out:
        out.close()
        with store.open_output_stream(f"{root}/index-{shard}.json", compression=None) as f:
            f.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "first": [first], "last": [last], "file": [f"index-{shard}.cdx"], "directory": [f"index-{shard}.json"], "blocks": [len(directory)], "captures": [n]})


def _ranged(store, path: str, at: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, at)


def _block(store, root: str, file: str, at: int, length: int) -> list[tuple[str, list]]:
    lines = zlib.decompress(_ranged(store, f"{root}/{file}", at, length)).decode().split("\n")
    return [(key, json.loads(rest)) for key, _, rest in (x.partition(" ") for x in lines)]


def captures(archive: Archive) -> DataFrame:
    """Every line of the index: key, page_id, file, offset, length. A task holds one block at a time."""
    folder = archive.folder

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for file, directory in zip(batch.column("file").to_pylist(), batch.column("directory").to_pylist(), strict=True):
                for _, at, length in json.loads(store.open_input_stream(f"{root}/{directory}").read()):
                    rows = [(key, *rest) for key, rest in _block(store, root, file, at, length)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE)

    n = max(1, archive.shards.count())
    return archive.shards.select("file", "directory").repartition(n, "file").mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def lookup(archive: Archive, urls: DataFrame) -> DataFrame:
    """(url, key, page_id, file, offset, length) of the captures of urls (column url), by two binary searches and one range read a block.

    The table of shards has as many rows as write_archive was told and is searched in every task; queries then go to their
    shards by a shuffle, where each shard's directory is searched for the blocks that may hold them, and on to the blocks by
    another, so that a block is read once. A key with more captures than a shard holds stands in several, which are read in
    tasks of their own. Urls without captures give no rows; repeated urls count once.
    """
    folder = archive.folder
    shards = archive.shards.select("first", "last", "file", "directory").orderBy("first", "last").collect()  # bounded: the parameter shards

    def to_shards(batches):
        for batch in batches:
            found = []
            for url in batch.column(0).to_pylist():
                key = reversed_host_key(url)
                at = bisect.bisect_left(shards, key, key=lambda s: s["last"])
                while at < len(shards) and shards[at]["first"] <= key:
                    found.append((url, key, shards[at]["file"], shards[at]["directory"]))
                    at += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["url", "key", "file", "directory"])

    def to_blocks(batches):
        store, root = _store(folder)
        known: tuple = (None, [])
        for batch in batches:
            found = []
            for url, key, file, directory in zip(*(batch.column(c).to_pylist() for c in ("url", "key", "file", "directory")), strict=True):
                if known[0] != directory:
                    known = directory, json.loads(store.open_input_stream(f"{root}/{directory}").read())
                at = max(0, bisect.bisect_left(known[1], key, key=lambda x: x[0]) - 1)
                while at < len(known[1]) and known[1][at][0] <= key:
                    found.append((url, key, file, *known[1][at][1:]))
                    at += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["url", "key", "file", "at", "size"])

    def in_block(batches):
        store, root = _store(folder)
        last: tuple = (None, [], [])
        for batch in batches:
            for url, key, file, at, size in zip(*(batch.column(c).to_pylist() for c in ("url", "key", "file", "at", "size")), strict=True):
                if last[0] != (file, at):
                    lines = _block(store, root, file, at, size)
                    last = (file, at), lines, [k for k, _ in lines]
                begin, end = bisect.bisect_left(last[2], key), bisect.bisect_right(last[2], key)
                if begin < end:
                    rows = [(url, key, *rest) for _, rest in last[1][begin:end]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *_CAPTURE.types], strict=True)], names=["url", *_CAPTURE.names])

    asked = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().mapInArrow(to_shards, "url string, key string, file string, directory string")
    asked = asked.repartition("file").sortWithinPartitions("file", "key").mapInArrow(to_blocks, "url string, key string, file string, at long, size long")
    asked = asked.repartition("file", "at").sortWithinPartitions("file", "at", "key")
    return asked.mapInArrow(in_block, "url string, key string, page_id long, file string, offset long, length long")


def read_records(archive: Archive, places: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at places (file, offset, length), by range reads in order: page_id, url, payload_bytes, payload_digest (of the payload
    that is there, made anew), stated_digest, record_type, refers_to, and with with_payload the payload."""
    folder, tasks = archive.folder, max(1, archive.shards.count())
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, ("payload", pa.binary())] if with_payload else fields)

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            for file, own in groupby(rows, key=lambda r: r[0]):
                with store.open_input_file(f"{root}/{file}") as f:
                    some, n = [], 0
                    for _, offset, length in own:
                        headers, payload = _parsed(zlib.decompress(f.read_at(length, offset), 31))
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        refers = headers.get("WARC-Refers-To")
                        row = (_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], len(payload), digest, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], refers and _page(refers))
                        some.append((*row, payload) if with_payload else row)
                        n += 300 + len(payload) * with_payload
                        if n > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
                            some, n = [], 0
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    ordered = places.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    spec = "page_id long, url string, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ordered.mapInArrow(run, spec)


def read_archive(archive: Archive, urls: DataFrame | None = None) -> DataFrame:
    """Records, found by the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With urls (column url): those of the captures of any of them, by lookup, which must include the responses that revisits
    among them refer to; else all records. A revisit has the size and digest of the response that it refers to, which is that
    of the page_id with the digest that it states; a response must state its own.
    """
    places = captures(archive) if urls is None else lookup(archive, urls).select("file", "offset", "length").distinct()
    found = written(read_records(archive, places), "records")
    first = found.where("record_type = 'response'").select(F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).distinct()
    both = found.join(first, (found["refers_to"] == first["o_id"]) & (found["stated_digest"] == first["o_digest"]), "left")
    size, digest = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.col("o_bytes")), F.when(F.col("refers_to").isNull(), F.col("payload_digest")).otherwise(F.col("o_digest"))
    sure: Column = F.when(digest == F.col("stated_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return both.select("page_id", "url", size.alias("payload_bytes"), sure.alias("payload_digest"), "record_type", "refers_to")

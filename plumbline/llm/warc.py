"""WARC archives with a two-level capture index.

Writing: every page becomes a record, gzipped by itself, in one WARC file per task, which opens
with a warcinfo record. Of records with equal payloads of at least MIN_REVISIT bytes the one with
the smallest page_id (of those, the smallest url digest) is a response and the others are revisits
without payload. Digests are grouped, not pages: only those that several pages share are joined
back to the pages, by broadcast while they are few (and always those that many pages share), so
payloads stay in the task that scanned them.

Indexing: captures are sorted by reversed host (`net,example,www)/path`) and page_id over range
partitions. Each partition is one index shard: lines in gzipped blocks of BLOCK_LINES, and a
sparse directory with the first key, offset and length of each block.

Reading: a key is searched by bisection among the shards' first keys, then in that shard's
directory, then in the block, and the record is one range read. Sorted keys find block and
file still open.

Files go to a folder under the shared checkpoint folder by pyarrow's file systems (file, hdfs,
s3, gs). A retried task writes files of another name; only those of the task that succeeded
are in the index. Keys, shards and directories are bounded by the index, records by a page.

A null html is an empty payload, a null url has the key `-`. Null page_ids come last. Of rows
that repeat page_id, url and payload one is the response, the others its revisits.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_size, cut, read, shared_dir, small_batches

MIN_REVISIT = 100
BLOCK_LINES = 512
#: Keys that a task of lookup searches.
LOOKUPS = 4096
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]+")
_HEADER = re.compile(rb"\r\n\r\n")


def surt(url: str | None) -> str:
    """Reversed-host key: `http://www.example.net/a?b` is `net,example,www)/a?b`."""
    if not url:
        return "-"
    scheme, mark, rest = url.partition("://")
    host, rest = re.match(r"([^/?#]*)(.*)", rest if mark else "", re.S).groups()
    return _UNSAFE.sub(lambda m: quote(m[0]), ",".join(reversed(host.lower().split("."))) + ")" + (rest if mark else url))


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3a://", "s3://", uri))


def record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. The HTTP header keeps the payload's full size, also in revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    named = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {named(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: quote(m[0]), url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {named(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The record's headers (names in lower case; the HTTP ones with `http-` before them) and its payload."""
    head, rest = _HEADER.split(data, 1)
    named = lambda block: {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n")[1:])}
    headers = named(head)
    block = rest[: int(headers["content-length"])]
    http, payload = _HEADER.split(block, 1)
    return headers | {f"http-{k}": v for k, v in named(http).items()}, payload


def warcinfo() -> bytes:
    """The record that opens a file."""
    fields = b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + fields + b"\r\n\r\n"


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, size, digest, payload (null for revisits), refers_to, revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = F.struct(F.col("page_id").isNull().alias("null_id"), F.col("page_id"), F.unhex(F.sha2(F.coalesce(F.col("url"), F.lit("")), 256)).alias("url_digest"))
    rows = pages.select("page_id", "url", F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha2(html, 256)).alias("digest"), html.alias("html"), own.alias("own"))
    seen = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "own").agg(F.count("*").alias("times"), F.first("url").alias("url"), F.first("size").alias("size"))
    seen = cut(seen)
    kept = F.min(F.struct("own", "times", "url", "size"))
    shared = cut(seen.groupBy("digest").agg(F.sum("times").alias("n"), kept.alias("kept")).where("n > 1").select("digest", "n", F.col("kept.own").alias("keep"), (F.col("kept.times") > 1).alias("repeats"), "kept.times", "kept.url", "kept.size"), seen)
    named = ["page_id", "url", "size", "digest", "payload", "refers_to", "revisit"]
    joined = by_size(rows, shared.select("digest", "n", "keep", "repeats"), ["digest"], "n", "left")
    revisit = F.coalesce(F.col("keep") != F.col("own"), F.lit(False))
    settled = joined.withColumn("revisit", revisit).withColumn("repeated", F.coalesce(F.col("repeats") & ~F.col("revisit"), F.lit(False)))
    out = settled.where("not repeated").select(
        "page_id", "url", "size", "digest", F.when(~F.col("revisit"), F.col("html")).alias("payload"), F.when(F.col("revisit"), F.col("keep.page_id")).alias("refers_to"), "revisit"
    )
    again = shared.where("repeats")
    if again.isEmpty():
        return out
    # Rows that repeat a response in everything: one is written with the payload, and as many revisits as there are others.
    one = settled.where("repeated").dropDuplicates(["digest"]).select("page_id", "url", "size", "digest", F.col("html").alias("payload"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), "revisit")
    others = again.select(F.col("keep.page_id").alias("page_id"), "url", "size", "digest", F.explode(F.sequence(F.lit(2), F.col("times"))).alias("nth")).select(
        "page_id", "url", "size", "digest", F.lit(None).cast("string").alias("payload"), F.col("page_id").alias("refers_to"), F.lit(True).alias("revisit")
    )
    return out.select(*named).unionByName(one.select(*named)).unionByName(others.select(*named))


def write_records(rows: DataFrame, base: str) -> DataFrame:
    """Writes one WARC file per task under base; returns key, page_id, file, offset, length of each record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = filesystem(base)
        name, out, at = f"{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            captures: list[tuple] = []
            for page_id, url, size, digest, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.compress(record(page_id, url, size, digest.hex(), (payload or "").encode(), refers_to, revisit), 6, mtime=0)
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(opening := gzip.compress(warcinfo(), 6, mtime=0))
                    at = len(opening)
                out.write(data)
                captures.append((surt(url), page_id, name, at, len(data)))
                at += len(data)
            keys, ids, names, offsets, lengths = zip(*captures, strict=True) if captures else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out:
            out.close()

    schema = f"key string, page_id {rows.schema['page_id'].dataType.simpleString()}, file string, offset long, length long"
    columns = ["page_id", "url", "size", "digest", "payload", "refers_to", "revisit"]
    return rows.select(*columns).mapInArrow(write, schema)


def _line_key(key: str, page_id: int | None) -> str:
    """Sorts like (key, page_id): ids are from -2^63, so they are shifted to be positive and padded; null is last."""
    return f"{key} {'~' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def line_key(key: Column, page_id: Column) -> Column:
    """_line_key as a column."""
    shifted = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(shifted, F.lit("~")))


@dataclass(frozen=True)
class Archive:
    """Where an archive lies, and the first line key, index file and directory file of each index shard, in order."""

    base: str
    shards: tuple[tuple[str, str, str], ...]


def write_index(captures: DataFrame, base: str) -> Archive:
    """Sorts captures by key, writes shards of blocks with their directories, and returns the archive."""
    sorted_rows = captures.select(line_key(F.col("key"), F.col("page_id")).alias("line_key"), "file", "offset", "length")
    parts = max(1, min(4096, -(-captures.count() // (64 * BLOCK_LINES))))
    ordered = sorted_rows.repartitionByRange(max(parts, 2), "line_key").sortWithinPartitions("line_key", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = filesystem(base)
        name, out, at, lines, directory = f"{task.partitionId():05d}-{task.taskAttemptId()}", None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            data = gzip.compress("".join(line for _, line in lines).encode(), 6, mtime=0)
            out = out or files.open_output_stream(f"{folder}/{name}.cdx.gz", compression=None)
            out.write(data)
            directory.append(f"{lines[0][0]}\t{at}\t{len(data)}\n")
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((key, f"{key}\t{file}\t{offset}\t{length}\n"))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with files.open_output_stream(f"{folder}/{name}.dir") as to:
                to.write("".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"first": [directory[0].split("\t")[0]], "index": [f"{name}.cdx.gz"], "directory": [f"{name}.dir"]})

    shards = ordered.mapInArrow(write, "first string, index string, directory string").collect()
    return Archive(base, tuple(sorted((r["first"], r["index"], r["directory"]) for r in shards)))


def write_archive(pages: DataFrame, base: str | None = None) -> tuple[Archive, DataFrame]:
    """Writes the archive of pages and returns it, with its captures (key, page_id, file, offset, length)."""
    small_batches(pages.sparkSession)
    base = base or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files, folder = filesystem(base)
    files.create_dir(folder, recursive=True)
    captures = cut(write_records(classified(pages), base))
    return write_index(captures, base), captures


class Reader:
    """Bisects the two levels of an archive's index and reads records by range; keeps a few directories, blocks and files open."""

    def __init__(self, archive: Archive, kept: int = 16) -> None:
        self.files, self.folder = filesystem(archive.base)
        self.firsts = [s[0] for s in archive.shards]
        self.shards, self.kept, self.cache = archive.shards, kept, OrderedDict()

    def _kept(self, key: tuple, make):
        if key not in self.cache:
            self.cache[key] = make()
            if len(self.cache) > self.kept:
                self.cache.popitem(last=False)
        self.cache.move_to_end(key)
        return self.cache[key]

    def _range(self, name: str, offset: int, length: int) -> bytes:
        return self._kept(("file", name), lambda: self.files.open_input_file(f"{self.folder}/{name}")).read_at(length, offset)

    def _directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        def load() -> tuple[list[str], list[tuple[int, int]]]:
            with self.files.open_input_stream(f"{self.folder}/{name}") as source:
                rows = [line.split("\t") for line in source.read().decode().splitlines()]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._kept(("directory", name), load)

    def _block(self, name: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
        def load() -> tuple[list[str], list[list[str]]]:
            lines = [line.split("\t") for line in gzip.decompress(self._range(name, offset, length)).decode().split("\n")[:-1]]
            return [x[0] for x in lines], lines

        return self._kept(("block", name, offset), load)

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture under a line key, which may run on over blocks and shards."""
        shard = max(0, bisect_left(self.firsts, key) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= key:
            _, index, directory = self.shards[shard]
            firsts, places = self._directory(directory)
            block = max(0, bisect_left(firsts, key) - 1)
            while block < len(firsts) and firsts[block] <= key:
                keys, lines = self._block(index, *places[block])
                for _, file, offset, length in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield file, int(offset), int(length)
                block += 1
            shard += 1

    def records(self, key: str) -> Iterator[tuple[dict[str, str], bytes]]:
        for file, offset, length in self.captures(key):
            yield parse_record(gzip.decompress(self._range(file, offset, length)))


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """The records of every distinct (key, page_id) of keys: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    keys are sorted over range partitions, so that neighbours share blocks. A response's payload is
    checked against its digest and length.
    """
    wanted = keys.select(line_key(F.col("key"), F.col("page_id")).alias("line_key")).distinct()
    tasks = max(1, -(-keys.count() // LOOKUPS))  # keys are short, records aren't: sizes of keys don't tell how much a task reads
    ordered = wanted.repartitionByRange(tasks, "line_key").sortWithinPartitions("line_key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        named = lambda value: int(value[10:-1]) if value and value != "<urn:page:>" else None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = []
                for key in batch.column(0).slice(low, 256).to_pylist():
                    for headers, payload in reader.records(key):
                        size, digest, kind = int(headers["http-content-length"]), headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"the payload of {headers['warc-record-id']} is not what its header says")
                        rows.append(
                            {
                                "page_id": named(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
                                "payload_digest": digest, "refers_to": named(headers.get("warc-refers-to")), "payload": payload if kind == "response" else None,
                            }
                        )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    return ordered.mapInArrow(search, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, captures = write_archive(read(spark, sf_dir, "pages"))
    return lookup(archive, captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
         payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM f
"""

"""WARC archives and their merged index (operator 10).

``write`` makes one WARC 1.1 record per row with Spark's own text writer (the record end
CR LF CR LF is the line separator), in files of about ``file_bytes``; each file
is sorted by URL key and time, so its records are a sorted run.  By default the files are not compressed, so the
index's offset and length are places in the file, where a record can be fetched alone; with ``compression="gzip"`` a file is one
gzip stream and they are places in its decompressed bytes.  Records with equal
payloads of at least ``least`` bytes are written once: the smallest id is the response,
the others are revisits that refer to it.  ``read`` parses the files by Content-Length,
so payloads may hold anything, and digests the payloads again.  ``merge_index`` cuts the key
space into ranges and, in each range, merges the runs by URL key and time with a loser
tree, which gives one globally ordered capture history.

Keys are integers.  Defined results: a null payload is an empty one and a response; a null URL is an empty
one; rows with equal payload and equal smallest id are all responses; a null id is written
as an empty one and read back as null; an empty table gives an empty archive and no rows.
Line breaks in URLs are written percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, written

# Fixed values of the WARC 1.1 standard.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
FILE_BYTES = 8 << 20


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: ``com,example)/a?b=1``; without scheme, www and fragment."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(text, r"^[a-z]+://(?:www\.)?([^/?#]*)", 1)
    rest = F.regexp_extract(text, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_time(key: Column) -> Column:
    """The tables have no fetch time: one is derived from the id, within the year 2024."""
    seconds = F.pmod(F.coalesce(key, F.lit(0)) * 7919, F.lit(31_536_000))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", time: Column | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, compression: str = "none") -> None:
    """Writes the archive folder ``path``; ``time`` is the capture time as text."""
    id_ = F.col(f"`{key}`").cast("long")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    plain = pages.select(
        id_.alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"), F.octet_length(body).alias("bytes"), F.sha2(body, 256).alias("digest"), (capture_time(id_) if time is None else time).alias("time"),
    )
    shared = plain.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("origin"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = written(shared, "shared-payloads")  # read by the write below, and discarded there
    size = plain.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    per_file = max(1, file_bytes // (1 + (size["b"] or 0) // max(1, size["n"]) + 600))

    again = F.col("origin").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("origin")))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit("\r\nWARC-Date: "), F.col("time"), F.lit("\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(F.col("origin")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("http") + F.when(again, F.lit(0)).otherwise(F.col("bytes")), F.lit(END), F.col("http"), F.when(again, F.lit("")).otherwise(F.col("body")),
    )
    rows = plain.join(shared, "digest", "left").withColumn("http", http).withColumn("key", url_key(F.col("url")))
    rows.sortWithinPartitions("key", "time", "id").select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)
    discard(shared)


_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")
_SCHEMA = "page_id long, url string, captured_at string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def _records(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, int, int]]:
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        if not raw.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        fields = dict(_FIELD.findall(raw[at:head]))
        stop = head + 4 + int(fields[b"Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield fields, raw[head + 4 : stop], at, stop + 4 - at
        at = stop + 4


def _page(name: bytes | None) -> int | None:
    digits = (name or b"")[len(b"<urn:x-page:") : -1]
    return int(digits) if digits else None


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archive; digests and sizes of responses are taken from their bytes.

    A revisit's payload is the one it refers to: its size and digest are those its header states.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for fields, block, at, length in _records(gzip.decompress(content.as_buffer()) if file.endswith(".gz") else content.as_buffer().to_pybytes()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, stated = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    if kind == "response":
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                        if digest != stated:
                            raise ValueError(f"{file}: the payload at byte {at} is damaged")
                    else:
                        n, digest = int(dict(_FIELD.findall(http))[b"Content-Length"]), stated
                    row = (_page(fields[b"WARC-Record-ID"]), fields[b"WARC-Target-URI"].decode(), fields[b"WARC-Date"].decode(), kind, _page(fields.get(b"WARC-Refers-To")), n, digest, file, at, length)
                    rows.append((*row, body if kind == "response" else None) if payload else row)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (10 + payload)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    schema = _SCHEMA + (", payload binary" if payload else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, schema)


class LoserTree:
    """Merges sorted iterators of comparable rows: each step replays one path of the tree."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.n = len(runs)
        self.tree = [-1] * max(1, self.n)
        for i in range(self.n):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _play(self, i: int) -> None:
        """Carries run i up from its leaf; losers stay in the inner nodes, the winner in node 0."""
        at = (i + self.n) // 2
        while at > 0:
            if self.tree[at] < 0:
                self.tree[at] = i
                return
            if self._beats(self.tree[at], i):
                self.tree[at], i = i, self.tree[at]
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple[int, object]]:
        while self.n and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield i, self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_index(records: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Adds ``url_key`` and ``position``, the place of each capture in the order (url_key, captured_at, page_id).

    ``records`` needs url, captured_at, page_id, file and offset, and each file must be sorted in that order.
    """
    keyed = written(records.withColumn("url_key", url_key(F.col("url"))), "captures")
    ranges = max(1, -(-keyed.count() // per_range))
    order = [F.col("url_key"), F.col("captured_at"), F.col("page_id").asc_nulls_first()]
    ranged = keyed.repartitionByRange(ranges, *order).withColumns({"range": F.spark_partition_id(), "position": F.lit(None).cast("long")})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().sort_by([("file", "ascending"), ("offset", "ascending")])
        if not len(t):
            return
        files = t["file"].to_pylist()
        starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
        page = [(-1 << 63) if x is None else x for x in t["page_id"].to_pylist()]
        rows = list(zip(t["url_key"].to_pylist(), t["captured_at"].to_pylist(), page, range(len(files)), strict=True))
        taken = [row[3] for _, row in LoserTree([iter(rows[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)])]
        out = t.take(pa.array(taken)).drop_columns(["position"]).append_column("position", pa.array(range(len(taken)), pa.int64()))
        yield from out.select(t.column_names).combine_chunks().to_batches()

    merged = written(ranged.mapInArrow(merge, ranged.schema), "merged-captures", keyed)
    counts = sorted(merged.groupBy("range").count().collect())  # one row per range
    base, offsets = 0, []
    for r, c in counts:
        offsets.append((r, base))
        base += c
    at = records.sparkSession.createDataFrame(offsets, "range int, base long")
    return merged.join(F.broadcast(at), "range").withColumn("position", F.col("position") + F.col("base")).drop("range", "base")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the pages to a new archive in the shared folder, reads it back, and merges its index."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, key, url, payload)
    return merge_index(read(pages.sparkSession, path))

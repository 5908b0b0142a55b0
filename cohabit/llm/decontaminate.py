"""Benchmark decontamination (operator 1).

The windows of the benchmark become a broadcast hash set; every document is
scanned once with rolling word-window hashes, hits are verified byte by byte, and
spans or whole documents are removed.  There is no shuffle of documents.

The set is broadcast in blocks of at most ``block_windows`` windows, whose number is
counted first, so memory stays bounded.  For a larger benchmark each block but one scans the texts alone and gives hits of distinct texts (by a
128-bit hash), which are merged and meet the documents in the one pass that returns them; no block rewrites documents.
A window of very many items is several rows of ``HELD_ITEMS`` each or so.

Item ids are integers.  Defined results: null and empty texts have no words and no hits; a benchmark item
without words has no window; repeated benchmark rows count once by their id; rows
with a null item id can hit words but add no id; an empty benchmark hits nothing.
Added columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, windows, words
from .common import free_name, mapped, without, written

WINDOW = 13
BLOCK_WINDOWS, HELD_ITEMS = 500_000, 1000
HITS, IDS = "array<struct<lo:int,hi:int>>", "array<long>"
ADDED = ("n_words", "hit_words", "item_ids", "spans", "n_hit", "clean_text")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """A row per distinct window (or per ``HELD_ITEMS`` of its items or so): n words, hash, its words joined by spaces, part, and the item ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_pylist()
            for w in words(b.column(0), ALNUM):
                h = w.hashes()
                out = []
                for r in range(w.rows):
                    lo, hi = int(w.at[r]), int(w.at[r + 1])
                    n = min(window, hi - lo)
                    if n:
                        keys = windows(h[lo:hi], n)
                        tokens = [w.word(i) for i in range(lo, hi)]
                        out += [(n, int(k.view(np.int64)), b" ".join(tokens[i : i + n]), ids[w.first + r]) for i, k in enumerate(keys)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=["n", "hash", "tokens", "item"])

    key = ["n", "hash", "tokens"]
    rows = benchmark.select(F.col(f"`{text}`").cast("string"), F.col(f"`{item}`").cast("long")).mapInArrow(cut, "n int, hash long, tokens binary, item long")
    rows = written(rows.distinct(), "window-items")
    many = rows.groupBy(*key).count().where(F.col("count") > HELD_ITEMS).select(*key, F.ceil(F.col("count") / HELD_ITEMS).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("item"), F.col("parts")), F.lit(0)).alias("part")
    found = rows.join(many, key, "left").select(*key, part, "item").groupBy(*key, "part").agg(F.collect_set("item").alias("items"))
    return written(found, "benchmark-windows", rows)


def _scanner(block, names: list[str], place: int, kept: int):
    """Marks the words of each document that any window of the block covers.

    The block's value: {n: {hash: [(tokens, items)]}}.  Rows come with their first ``kept`` columns, the text among them at ``place``, and, if there are more, the hits
    and item ids that other blocks gave (lists of lists); they leave with ``names``.
    """
    filters: dict = {}

    def prepare() -> dict:
        if not filters:
            for n, by_hash in block.value.items():
                keys = np.sort(np.array(list(by_hash), dtype=np.int64).view(np.uint64))
                bits = np.zeros(1 << 22, dtype=bool)
                bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                filters[n] = (keys, bits)
        return filters

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_n = prepare()
        for b in batches:
            n_words = np.zeros(len(b), dtype=np.int64)
            hits, ids = [[] for _ in range(len(b))], [[] for _ in range(len(b))]
            if b.num_columns > kept:
                for i, (spans, items) in enumerate(zip(b.column(kept).to_pylist(), b.column(kept + 1).to_pylist(), strict=True)):
                    hits[i] = _merge([(x["lo"], x["hi"]) for some in spans or [] for x in some])
                    ids[i] = sorted({x for some in items or [] for x in some})
            for w in words(b.column(place), ALNUM):
                n_words[w.first : w.first + w.rows] = np.diff(w.at)
                h, row = w.hashes(), w.row_of_word()
                found: dict[int, list] = {}
                for n, (keys, bits) in by_n.items():
                    k = windows(h, n)
                    maybe = np.flatnonzero(bits[(k & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    maybe = maybe[row[maybe] == row[maybe + n - 1]]
                    maybe = maybe[np.isin(k[maybe], keys)]
                    for i, key in zip(maybe.tolist(), k[maybe].view(np.int64).tolist(), strict=True):
                        tokens = b" ".join([w.word(j) for j in range(i, i + n)])
                        for known, items in block.value[n][key]:
                            if known == tokens:
                                found.setdefault(int(row[i]), []).append((i - int(w.at[row[i]]), n, items))
                for r, spans in found.items():
                    at = w.first + r
                    hits[at] = _merge([(x["lo"], x["hi"]) for x in hits[at]] + [(i, i + n) for i, n, _ in spans])
                    ids[at] = sorted({*ids[at], *(x for _, _, items in spans for x in items)})
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(n_words), pa.array(hits, kind), pa.array(ids, pa.list_(pa.int64()))], names=names)

    return scan


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1]["hi"]:
            out[-1]["hi"] = max(hi, out[-1]["hi"])
        else:
            out.append({"lo": lo, "hi": hi})
    return out


def _cutter(names: list[str], place: int, hit_place: int):
    """Spans of hit words in code points, and the text without them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place)
            hits = b.column(hit_place).to_pylist()
            spans: list = [[] for _ in hits]
            clean = texts.to_pylist()
            hit = [i for i, x in enumerate(hits) if x]
            for w in words(texts.take(pa.array(hit, pa.int64())), ALNUM):
                for r in range(w.rows):
                    at, raw = hit[w.first + r], w.data[w.offsets[r] : w.offsets[r + 1]].tobytes()
                    kept, last = [], 0
                    for x in hits[at]:
                        lo, hi = (int(v - w.offsets[r]) for v in (w.start[w.at[r] + x["lo"]], w.end[w.at[r] + x["hi"] - 1]))
                        kept.append(raw[last:lo])
                        spans[at].append({"start": len(raw[:lo].decode()), "end": len(raw[:hi].decode())})
                        last = hi
                    clean[at] = b"".join([*kept, raw[last:]]).decode()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind), pa.array(clean, pa.string())], names=names)

    return cut


def contaminated(words_per_hit: int = 20):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * words_per_hit >= F.col("n_words"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit, hit_words (word ranges) and item_ids to each document; needs the column ``text``."""
    spark = docs.sparkSession
    found = benchmark_windows(benchmark, window)
    total = found.agg(F.sum(F.greatest(F.size("items"), F.lit(1)))).first()[0] or 0
    blocks = max(1, -(-total // block_windows))

    def scanned(df: DataFrame, k: int, kept: int) -> DataFrame:
        value: dict = {}
        for r in found.where(F.pmod(F.xxhash64("hash", "part"), F.lit(blocks)) == k).toLocalIterator():
            value.setdefault(r["n"], {}).setdefault(r["hash"], []).append((bytes(r["tokens"]), list(r["items"])))
        first = df.select(*[F.col(f"`{c}`") for c in df.columns[:kept]])
        shape = first.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(HITS).alias("hit_words"), F.lit(None).cast(IDS).alias("item_ids"))
        return mapped(df, _scanner(spark.sparkContext.broadcast(value), shape.columns, df.columns.index(text), kept), shape.schema)

    plain = without(docs, *ADDED)
    kept = len(plain.columns)
    if blocks > 1:
        content = F.col(f"`{text}`").cast("string")
        keys = [free_name(plain, x) for x in ("_text1", "_text2")]
        hashes = [F.xxhash64(F.lit(k), content) for k in keys]
        parts = None
        for k in range(1, blocks):
            hit = scanned(plain.select(*[h.alias(c) for h, c in zip(hashes, keys, strict=True)], content.alias(text)), k, 3).where(F.size("hit_words") > 0)
            one = hit.groupBy(*keys).agg(F.first("hit_words").alias("hit_words"), F.first("item_ids").alias("item_ids"))  # copies of a text have the same hits
            part = written(one, "block-hits")
            parts = part if parts is None else parts.unionByName(part)
        lists = [free_name(plain, x) for x in ("_hits", "_ids")]
        merged = parts.groupBy(*keys).agg(F.collect_list("hit_words").alias(lists[0]), F.collect_list("item_ids").alias(lists[1]))  # a row for each block at most
        plain = plain.withColumns(dict(zip(keys, hashes, strict=True))).join(merged, keys, "left").select(*[F.col(f"`{c}`") for c in [*plain.columns, *lists]])
    out = scanned(plain, 0, kept)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return out.withColumn("n_hit", n_hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document", words_per_hit: int = 20, window: int = WINDOW, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Removes contaminated documents (``document``) or only the hit spans (``span``).

    A document is contaminated if one word in ``words_per_hit``, and one at least, is hit.
    ``span`` keeps all rows and adds ``spans`` (code points, end exclusive) and ``clean_text``.
    """
    if action not in ("document", "span"):
        raise ValueError(f"action {action!r} is neither 'document' nor 'span'")
    if action == "document":
        # the filter adds no column, so input columns of these names stay
        aside = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in ADDED}
        kept = mark(docs.withColumnsRenamed(aside), benchmark, window, aside.get(text, text), block_windows).where(~contaminated(words_per_hit))
        return kept.drop(*ADDED).withColumnsRenamed({to: c for c, to in aside.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
    marked = mark(docs, benchmark, window, text, block_windows)
    shape = marked.select("*", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("string").alias("clean_text"))
    return mapped(marked, _cutter(shape.columns, marked.columns.index(text), marked.columns.index("hit_words")), shape.schema)

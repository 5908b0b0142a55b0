"""N-gram Jaccard join (operator 5) with a token-group matrix, exact.

1. Texts become sets of word-shingle hashes inside tasks; equal sets (128-bit fingerprint)
   are one *set* from here on, so copies cost one row each.
2. Similar sets are partitioned into groups: three MinHash values each elect a leader, the
   leaders are compared exactly, and the links found give first components.  Those of eight sets or
   more are groups; the other sets are grouped by a MinHash value.  A group is stored in chunks of about
   ``chunk`` sets.
3. Token-group matrix: two similar sets of n tokens share at least l of their first
   n - ceil(t n) + l tokens in any fixed order, so only those tokens are stored, as (token, group);
   l = 1 + n / 20.  The order puts tokens that many documents hold last (their counts are taken
   over all documents), which keeps common passages out of the matrix.
4. A set opens a group that holds another component only if enough shared tokens and the size range allow it;
   there the overlap with the group's token union must reach ceil(t n), and then it is compared
   with the members.  One link to each component that it meets is kept, and a set never opens a
   group that holds its own component only.

No pair list of a group is formed: candidates are (set, group) rows.  Texts, not token
arrays, are shuffled to the few comparisons, and a bitmap of fixed size over the ids in question
keeps most other texts out of that shuffle (it may let some pass, never drops one).

Keys are integers.  Defined results: null, empty and blank texts have no shingles and link with nothing;
a text of fewer than ``n`` words is one shingle; rows that repeat a doc_id are one node; rows
with a null doc_id take the component of their copies, else null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SOLID, _mix, windows, words
from .common import count_bucket, discard, free_name, least_bucket, written
from .components import components

SEEDS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
HOT, HOT_LIMIT = 32, 2_000_000
BITMAP = 1 << 27


def shingle_runs(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Shingle hashes of each text in order; a text of fewer words is one shingle."""
    for w in words(texts, SOLID):
        h = w.hashes()
        k = windows(h, n)
        for lo, hi in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
            yield k[lo : hi - n + 1] if hi - lo >= n else windows(h[lo:hi], hi - lo) if hi > lo else k[:0]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return map(np.unique, shingle_runs(texts, n))


def least_overlap(size, num: int, den: int):
    """ceil(num / den * size)"""
    return -(-num * size // den)


def shared_least(size):
    """l: tokens that two similar sets share at least among their first ones."""
    return 1 + size // 20


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)) or not len(a):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both * den >= num * (len(a) + len(b) - both)


def _signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """(id, text) to (id, size, two fingerprints, three MinHash values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((len(b), 6), dtype=np.int64)
            for i, s in enumerate(shingle_sets(b.column(1), n)):
                if len(s):
                    out[i] = (len(s), _signed(s.sum(dtype=np.uint64)), _signed(np.bitwise_xor.reduce(_mix(s ^ SEEDS[1]))), *(_signed(_mix(s ^ seed).min()) for seed in SEEDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k]) for k in range(6))], names=["id", "size", "f1", "f2", "m0", "m1", "m2"])

    return docs.mapInArrow(run, "id long, size long, f1 long, f2 long, m0 long, m1 long, m2 long")


def prefixes(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """(id, text) to (id, size, its first tokens; tokens in ``hot``, sorted, come last)."""
    at = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = at.value
        for b in batches:
            sizes, out = [], []
            for s in shingle_sets(b.column(1), n):
                sizes.append(len(s))
                if not len(s):
                    out.append(s.view(np.int64))
                    continue
                need = len(s) - least_overlap(len(s), num, den) + shared_least(len(s))
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = known[i] == s
                    s = np.concatenate((s[~common], s[common]))
                out.append(s[:need].view(np.int64))
            ptr = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), tokens], names=["id", "size", "tokens"])

    return docs.mapInArrow(run, "id long, size long, tokens array<long>")


def _near(docs: DataFrame, n: int, hot: np.ndarray, reach: int = 16) -> DataFrame:
    """Tokens that stand within ``reach`` places of a hot one in some text: one row per text and token."""
    at = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = at.value
        for b in batches:
            found = []
            for k in shingle_runs(b.column(1), n):
                common = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
                where = np.flatnonzero(common)
                if len(where):
                    d = np.zeros(len(k) + 1, dtype=np.int64)
                    np.add.at(d, np.maximum(where - reach, 0), 1)
                    np.add.at(d, np.minimum(where + reach + 1, len(k)), -1)
                    found.append(np.unique(k[(np.cumsum(d)[:-1] > 0) & ~common]))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else known[:0]).view(np.int64))], names=["token"])

    return docs.mapInArrow(run, "token long")


def hot_tokens(docs: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """Tokens that stand among the first tokens of more than ``HOT`` documents, sorted; the most common, ``HOT_LIMIT`` at most.

    Hot tokens come from common passages, whose other tokens stand beside them: those are counted in a second
    round.  Hot tokens only set the order of tokens, never the result.
    """

    def common(tokens: DataFrame) -> np.ndarray:
        counts = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "token-counts")
        found = counts.where(count_bucket(F.col("n")) >= least_bucket(counts, HOT_LIMIT)).select("token").toArrow()
        discard(counts)
        return found["token"].to_numpy().view(np.uint64)

    none = np.zeros(0, dtype=np.uint64)
    hot = np.unique(common(prefixes(docs, n, num, den, none).select(F.explode("tokens").alias("token"))))
    return np.union1d(hot, common(_near(docs, n, hot))) if len(hot) else hot


def _texts_of(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (id, text) whose id may be in ``ids`` (id): a bitmap of BITMAP bits decides, so some others pass."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    word = ids.select(F.shiftright(bit, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int")).alias("bits"))
    found = word.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITMAP / 32 rows
    words32 = np.zeros(BITMAP // 32, dtype=np.uint32)
    words32[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    del found
    pa.default_memory_pool().release_unused()
    at = plain.sparkSession.sparkContext.broadcast(words32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(2).to_numpy()
            yield b.select([0, 1]).filter(pa.array((at.value[k >> 5] >> (k & 31).astype(np.uint32)) & 1 == 1))

    return plain.select("id", "text", bit.alias("bit")).mapInArrow(run, "id long, text string")


def _compare(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, text of a, text of b) to the (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                hit = [linked(x, y, num, den) for x, y in zip(shingle_sets(b.column(2), n), shingle_sets(b.column(3), n), strict=True)]
                yield b.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _open(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per group and block of visitors: (visitor, member), one for each other root among the members that it links to."""

    def run(group):
        group = group.combine_chunks()
        ids, own, root = (group[c].to_numpy(zero_copy_only=False) for c in ("id", "member", "root"))
        sets = list(shingle_sets(group["text"].chunk(0) if group.num_rows else pa.array([], pa.string()), n))
        size = np.array([len(x) for x in sets], dtype=np.int64)
        members = np.flatnonzero(own)
        tokens = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, holder = tokens[order], np.repeat(np.arange(len(members)), size[members])[order]
        out = []
        for i in np.flatnonzero(~own.astype(bool)).tolist():
            lo, hi = (np.searchsorted(tokens, sets[i], side) for side in ("left", "right"))
            held = hi - lo
            # the bound: overlap with the union of the group
            if not size[i] or int((held > 0).sum()) < least_overlap(int(size[i]), num, den):
                continue
            at = np.arange(held.sum()) + np.repeat(lo - np.cumsum(held) + held, held)
            both = np.bincount(holder[at], minlength=len(members))
            hit = (both * den >= num * (size[i] + size[members] - both)) & (root[members] != root[i])
            for r in np.unique(root[members][hit]):
                out.append((ids[i], ids[members][hit & (root[members] == r)][0]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.groupBy("group", "block").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, chunk: int = 256) -> DataFrame:
    """(key, n_shingles, component_id) for every row: link where den * intersection >= num * union."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = written(describe(plain, n), "sets")
    sets = written(rows.where("size > 0").groupBy("size", "f1", "f2").agg(F.min("id").alias("rep"), F.first("m0").alias("m0"), F.first("m1").alias("m1"), F.first("m2").alias("m2")), "distinct-sets")
    named = sets.where("rep is not null")

    # leaders of the MinHash groups
    votes = named.select("rep", "size", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(3)])).alias("vote")).select("rep", "size", "vote.*")
    leaders = written(votes.groupBy("k", "m").agg(F.min_by("size", "rep").alias("own"), F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c"), "leaders")
    pairs = written(votes.join(leaders, ["k", "m"]).where((F.col("rep") != F.col("leader")) & (F.least("size", "own") * den >= F.greatest("size", "own") * num)).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "leader-pairs", leaders)
    texts = _texts_of(plain, pairs.select(F.col("a").alias("id")))
    first = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    both = first.join(_texts_of(plain, pairs.select(F.col("b").alias("id"))).withColumnsRenamed({"id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    edges = written(_compare(both, n, num, den), "leader-links", pairs)
    grouped = components(edges)

    # groups in chunks
    member = named.select(F.col("rep").alias("id"), "size", "m0").distinct().join(grouped.withColumnRenamed("node", "id"), "id", "left").select("id", "size", "m0", F.coalesce("root", "id").alias("root"))
    member = first_members = written(member, "members")
    large = written(member.groupBy("root").count().where("count >= 8").withColumnRenamed("count", "c"), "large-components")
    member = member.join(large, "root", "left").withColumn("kin", F.when(F.col("c").isNotNull(), F.xxhash64(F.lit("root"), "root")).otherwise(F.xxhash64(F.lit("sketch"), "m0"))).drop("c", "m0")
    member = kin = written(member, "kin", first_members, large)
    many = written(member.groupBy("kin").count().where(F.col("count") > chunk).select("kin", F.ceil(F.col("count") / chunk).alias("chunks")), "large-groups")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("chunks")), F.lit(0))
    member = written(member.join(many, "kin", "left").select("id", "size", "root", F.xxhash64("kin", part).alias("group")), "groups", kin, many)

    # the token-group matrix, and who reaches which group
    hot = hot_tokens(plain, n, num, den)
    first_tokens = written(prefixes(plain, n, num, den, hot).where("size > 0"), "prefixes")
    matrix = first_tokens.select("id", F.explode("tokens").alias("token"))
    shared = written(matrix.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token"), "shared-tokens")
    cells = written(matrix.join(shared, "token").join(member, "id").select("token", "id", "size", "root", "group"), "cells", first_tokens, shared)
    unions = cells.groupBy("token", "group").agg(F.min("root").alias("other"), F.min("size").alias("least"), F.max("size").alias("most"))
    smaller = F.ceil(F.col("size") * num / den)
    enough = F.least(smaller, 1 + F.floor(smaller / 20))
    reach = cells.select("token", "id", "size", "root").join(unions, "token").where((F.col("root") > F.col("other")) & (F.col("size") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("size") * den))
    visits = written(reach.groupBy("id", "size", "root", "group").count().where(F.col("count") >= enough).select("id", "root", "group"), "visits", cells)

    # open the groups
    blocks = written(visits.groupBy("group").agg(F.ceil(F.count("*") / 128).alias("blocks")), "visited")
    guests = visits.join(blocks, "group").select("id", "root", "group", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(False).alias("member"))
    hosts = member.join(blocks, "group").select("id", "root", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("member"))
    both = written(guests.unionByName(hosts), "openings", visits, blocks, member)
    opened = both.join(_texts_of(plain, both.select("id")), "id")
    edges = edges.unionByName(written(_open(opened, n, num, den), "group-links", both))

    roots = components(edges).withColumnRenamed("node", "rep")
    final = written(sets.select("size", "f1", "f2", "rep").join(roots, "rep", "left").select("size", "f1", "f2", F.coalesce("root", "rep").alias("root")), "set-roots")
    out = rows.select("id", "size", "f1", "f2").join(final, ["size", "f1", "f2"], "left")
    return out.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Keeps, of each component, the row with the smallest key (one row if it repeats); all columns stay.

    Rows with a null key cannot be named by a component; they are all kept.
    """
    root, rank = free_name(docs, "_root"), free_name(docs, "_rank")
    found = classes(docs, key, text, n, num, den).where(f"`{key}` = component_id").select(F.col(f"`{key}`").alias(root)).distinct()
    kept = docs.join(written(found, "kept"), F.col(f"`{key}`") == F.col(root), "left_semi")
    order = Window.partitionBy(f"`{key}`").orderBy(F.xxhash64(f"`{text}`"))
    kept = kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.unionByName(docs.where(F.col(f"`{key}`").isNull()))

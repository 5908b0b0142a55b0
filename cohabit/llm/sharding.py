"""Sharding (operator 6) by sampled splitters; DataFrame functions only.

1. Every record has a sort key: the high bits hash its text, the low bits the record, so equal
   texts lie side by side and even a very large group of copies can be divided among tasks.
2. Groups of equal texts of over one part in ``per_shard`` of a shard (so at most shards x per_shard of them)
   are placed whole, largest first, on the emptiest shard, as long as that stays below the level that all shards end at.
   One that doesn't fit is cut, and fills the emptiest shards up to that level.
3. A size-weighted sample of the keys (each record enters with a probability in proportion
   to its size) gives the quantiles that split the key space into ranges.
   The ranges' exact sizes are added up; ranges of over twice the mean are subdivided by key.
4. Within ranges a running sum, plus the offsets of the ranges before, gives each small group's exact
   place in the global order.  The shards' rooms, one after the other, lie along that order too, and
   a small group goes where its middle lies.  So no group that fits in a shard is cut, and sizes differ by about
   one part in ``per_shard`` (law ``bytes``), or by one record if that is larger.

Only the sample's quantiles, one row per range and shard, and the large groups (all fixed numbers) reach the driver.

Defined results: null texts count 8 bytes, have the CRC of the empty text and belong to its group; repeated rows are
records of their own; with fewer records than shards some shards stay empty; an empty table
gives no rows; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

SAMPLE = 20_000
PER_SHARD = 100
LOW_BITS = 20


def _reached(key: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts the key has reached: a binary search in an array, so that the code of a plan doesn't grow with the cuts."""
    if not cuts:
        return F.lit(0)
    table = F.lit(list(cuts))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.get(table, n + step - 1) <= key, n + step).otherwise(n))


def level(loads: Sequence[float], rest: float) -> float:
    """The height that all shards reach when ``rest`` is poured over their loads."""
    low, base = sorted(loads), 0.0
    for k, x in enumerate(low, 1):
        base += x
        if k == len(low) or (base + rest) / k <= low[k]:
            return (base + rest) / k
    return rest


def place(groups: Sequence[tuple[int, int, int]], shards: int, total: int, slack: float) -> tuple[dict[int, int], dict[int, list[tuple[float, int]]], list[float]]:
    """Large groups (group, bytes, records) to: shard of each whole one, (bytes, shard) parts of each cut one, load of each shard."""
    loads, rest = [0.0] * shards, float(total)
    whole: dict[int, int] = {}
    cut: dict[int, list[tuple[float, int]]] = {}
    for group, size, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        k, top = min(range(shards), key=lambda i: (loads[i], i)), level(loads, rest)
        if n == 1 or loads[k] + size <= top + slack:
            whole[group] = k
            loads[k] += size
        else:
            left, parts = float(size), []
            for k in sorted(range(shards), key=lambda i: (loads[i], i)):
                part = min(left, max(0.0, top - loads[k]))
                if part > 0:
                    parts.append((part, k))
                    loads[k] += part
                    left -= part
            cut[group] = parts
        rest -= size
    return whole, cut, loads


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", ranges_per_shard: int = 8, sample: int = SAMPLE, per_shard: int = PER_SHARD) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row; slots are gapless from 0 in each shard."""
    id_, content = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    group = F.shiftright(F.xxhash64(F.coalesce(content, F.lit(""))), LOW_BITS)
    low = F.pmod(F.xxhash64(id_, F.monotonically_increasing_id()), F.lit(1 << LOW_BITS))
    plain = docs.select(
        id_.alias("id"), (F.coalesce(F.octet_length(content), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("crc"),
        group.alias("group"), (group * (1 << LOW_BITS) + low).alias("key"),
    )
    records = written(plain, "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    limit = max(total, 1) / shards / per_shard
    found = records.groupBy("group").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where(F.col("b") > limit).collect()  # at most shards x per_shard rows
    whole, cut, loads = place([tuple(r) for r in found], shards, total, limit)
    spark = docs.sparkSession
    large = spark.createDataFrame([(g, k, False) for g, k in whole.items()] + [(g, None, True) for g in cut], "group long, home int, cut boolean")
    small = F.col("cut").isNull()

    # ranges: the groups that stay together have one key for this
    want = shards * ranges_per_shard
    dice = F.pmod(F.xxhash64("key", "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(dice < F.col("size") * (sample / max(total, 1)))
    cuts = drawn.agg(F.percentile_approx("key", [k / want for k in range(1, want)], 100 * want)).first()[0]
    cuts = sorted(set(cuts or []))
    tagged = records.join(F.broadcast(large), "group", "left").withColumn("at", F.when(small, F.col("group") * (1 << LOW_BITS)).otherwise(F.col("key")))
    ranged = tagged.withColumn("range", _reached(F.col("at"), cuts))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("b")).collect()  # one row per range
    mean = max(1, total // max(1, len(sums)))
    split = F.lit(0)
    for r, b in sorted(map(tuple, sums)):
        if (k := -(-b // (2 * mean))) > 1:
            split = F.when(F.col("range") == r, F.floor((F.col("at").cast("double") - _first(cuts, r)) / _span(cuts, r) * k).cast("int")).otherwise(split)
    ranged = ranged.withColumn("part", split)

    # exact places: bytes of small groups, and of groups that are cut, before each record
    filled = F.when(small, F.col("size")).otherwise(0)
    apart = F.when(F.col("cut"), F.col("size")).otherwise(0)
    blocks = sorted(map(tuple, ranged.groupBy("range", "part").agg(F.sum(filled), F.sum(apart)).collect()))  # one row per range or part of it
    offsets, small_bytes, cut_bytes = [], 0, 0
    for r, p, b, c in blocks:
        offsets.append((r, p, small_bytes, cut_bytes))
        small_bytes, cut_bytes = small_bytes + b, cut_bytes + c
    at = F.broadcast(spark.createDataFrame(offsets, "range int, part int, small0 long, cut0 long"))
    inside = Window.partitionBy("range", "part").orderBy("at", "key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    together = Window.partitionBy("range", "part", "group")
    run = ranged.withColumns({"small_at": F.sum(filled).over(inside) - filled, "cut_at": F.sum(apart).over(inside) - apart}).join(at, ["range", "part"])
    middle = F.col("small0") + F.min("small_at").over(together) + F.sum("size").over(together) / 2

    top, bounds, homes = level(loads, small_bytes), [], []
    for k, load in enumerate(loads):
        if (room := top - load) > 0:
            homes.append(k)
            bounds.append((bounds[-1] if bounds else 0.0) + room)
    edges, owners, done = [], [], 0.0
    for _, parts in sorted(cut.items()):
        for part, k in parts:
            done += part
            edges.append(done)
            owners.append(k)
    pick = lambda shard_of, place_, ends: F.get(F.lit(shard_of), _reached(place_, ends[:-1])) if shard_of else F.lit(0)
    shard = F.when(small, pick(homes, middle, bounds)).when(F.col("cut"), pick(owners, F.col("cut0") + F.col("cut_at"), edges)).otherwise(F.col("home")).cast("int")
    local = Window.partitionBy("range", "part", "shard").orderBy("at", "key", "id", "size")
    sharded = run.withColumn("shard", shard).withColumn("row", F.row_number().over(local).cast("long") - 1).select("id", "size", "crc", "range", "part", "shard", "row")
    sharded = written(sharded, "shard-rows", records)

    counts = sorted(map(tuple, sharded.groupBy("shard", "range", "part").count().collect()))  # a fixed number of ranges and shards
    firsts, before = [], 0
    for i, (k, r, p, n) in enumerate(counts):
        before = before if i and counts[i - 1][0] == k else 0
        firsts.append((k, r, p, before))
        before += n
    first = F.broadcast(spark.createDataFrame(firsts, "shard int, range int, part int, first long"))
    out = sharded.join(first, ["shard", "range", "part"])
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") + F.col("first")).alias("slot"))


def _first(cuts: list[int], r: int) -> float:
    return float(cuts[r - 1]) if r else -(2.0**63)


def _span(cuts: list[int], r: int) -> float:
    return (float(cuts[r]) if r < len(cuts) else 2.0**63) - _first(cuts, r) + 1.0


def write(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", text: str = "text") -> None:
    """Writes the rows, sorted by slot, to one folder per shard (``shard=k``).  Keys must be unique and not null."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    places = assign(docs, shards, key, text).select(F.col(f"`{key}`"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    docs.join(places, key).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)

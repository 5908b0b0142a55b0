"""Embedding near-dedup (operator 9): exact metric range join on unit vectors.

cos(x, y) >= t means a distance of at most r = sqrt(2 - 2 t) between unit vectors.  Pivots (a
hash sample of the vectors) divide the space into the cells of their nearest pivot.  A
partner of x in cell j can exist only if

* d(x, p_j) <= d(x, p_home) + 2 r        (triangle inequality, twice),
* (d(x, p_j)^2 - d(x, p_home)^2) / (2 d(p_home, p_j)) <= r   (distance to the bisecting plane),
* d(x, p_j) <= R_j + r                   (R_j: radius of cell j),

so x is replicated to those cells only, and only to cells after its own: every pair meets
once.  A cell of more vectors than a block may hold gets pivots of its own, as many as it needs, and its members and
visitors go to its sub-cells by the first two rules.  What is still too large is cut by hash.
Each block joins its own vectors and its visitors on its own, in tiles around local pivots: two tiles whose
centres are further apart than their radii and r are skipped, the others are matrix products.  A block emits link *counts* and
the components of its own link graph (at most one edge for each vector), never its pairs.
Equal vectors are one vector with a multiplicity.

Products in single precision are trusted only outside a margin of 1e-4 around the threshold;
tiles with a value inside it are computed again in double precision.

Keys are integers.  Defined results: vectors that are null, zero, empty, or hold null or non-finite components link
with nothing and are kept; vectors of different lengths never link; copies link with
each other; rows with a null id have a null component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components

#: Pivots of the first level at most (they are broadcast), bytes of the vectors of a block, rows of a tile.
MAX_PIVOTS, BLOCK_BYTES, TILE = 512, 8 << 20, 512
MARGIN = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _place(vectors: DataFrame, pivots: np.ndarray, radii: np.ndarray | None, r: float) -> DataFrame:
    """(rep, v) to (rep, v, home, near, visits): nearest pivot, distance to it, later cells to visit (none without radii)."""
    at = vectors.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, radius = at.value
        between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18))
        for b in batches:
            if not len(b):
                continue
            d2 = np.maximum(2 - 2 * _matrix(b.column(1)) @ p.T, 0)
            d, home = np.sqrt(d2), d2.argmin(1)
            near = d[np.arange(len(b)), home]
            visits: list = [[]] * len(b)
            if radius is not None:
                slack = 1e-7
                go = (d <= near[:, None] + 2 * r + slack) & ((d2 - near[:, None] ** 2) / (2 * between[home]) <= r + slack) & (d <= radius + r + slack)
                go &= np.arange(len(p)) > home[:, None]
                visits = [np.flatnonzero(x).astype(np.int32) for x in go]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home, pa.int32()), pa.array(near), pa.array(visits, pa.list_(pa.int32()))], names=["rep", "v", "copies", "home", "near", "visits"])

    return vectors.mapInArrow(run, "rep long, v array<double>, copies long, home int, near double, visits array<int>")


def _local_roots(hit: np.ndarray, a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> None:
    """Joins, in ``parent``, the nodes a (rows) and b (columns) that the hits connect."""

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent.setdefault(up, up)
            x = up
        return x

    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return
    hit = hit[np.ix_(rows, cols)]
    label, before = np.arange(len(rows)), None
    far = len(rows)
    while before is None or (label != before).any():
        before = label
        down = np.where(hit, label[:, None], far).min(0)
        label = np.minimum(label, np.where(hit, down[None, :], far).min(1))
    down = np.where(hit, label[:, None], far).min(0)
    for ids, lab in ((a[rows], label), (b[cols], down)):
        for x, k in zip(ids.tolist(), lab.tolist(), strict=True):
            p, q = find(x), find(int(a[rows[k]]))
            if p != q:
                parent[max(p, q)] = min(p, q)


def _tiles(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Rows in tiles of TILE at most around rows of their own: (rows, centre, radius)."""
    if not len(x):
        return []
    p = x[:: max(1, TILE // 2)]
    near = np.concatenate([(x[k : k + 4096] @ p.T).argmax(1) for k in range(0, len(x), 4096)])
    order = np.argsort(near, kind="stable")
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        for k in range(0, len(rows), TILE):
            part, centre = rows[k : k + TILE], p[near[rows[0]]]
            out.append((part, centre, float(np.sqrt(np.maximum(2 - 2 * x[part] @ centre, 0)).max())))
    return out


def _block(t: float):
    r = float(np.sqrt(2 - 2 * t))

    def run(group):
        group = group.combine_chunks()
        ids, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        own, x = group["own"].to_numpy(zero_copy_only=False), _matrix(group["v"].chunk(0) if group.num_rows else pa.array([], pa.list_(pa.float64())))
        first = bool(group["visitors"][0].as_py() == 0) if group.num_rows else False
        x32 = x.astype(np.float32)
        homes, guests = np.flatnonzero(own), np.flatnonzero(~own)
        counts, parent = np.zeros(len(ids), dtype=np.int64), {}

        def join(rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
            s = x32[rows] @ x32[cols].T
            if (np.abs(s - t) < MARGIN).any():
                s = x[rows] @ x[cols].T
            hit = s >= t
            if same:
                hit &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
            if hit.any():
                np.add.at(counts, rows, hit @ copies[cols])
                np.add.at(counts, cols, copies[rows] @ hit)
                _local_roots(hit, ids[rows], ids[cols], parent)

        mine, others = ([(where[rows], c, far) for rows, c, far in _tiles(x[where])] for where in (homes, guests))
        for i, (rows, centre, far) in enumerate(mine):
            # a tile meets itself, the tiles after it, and the visitors'
            for k, (cols, other, reach) in enumerate([*(mine[i:] if first else []), *others]):
                if np.sqrt(max(2 - 2 * float(centre @ other), 0)) <= far + reach + r + 1e-6:
                    join(rows, cols, first and k == 0)
        some = np.flatnonzero(counts)
        root = [parent.get(i, i) for i in ids[some].tolist()]
        return pa.table({"rep": pa.array(ids[some]), "links": pa.array(counts[some]), "joined": pa.array(root, pa.int64())})

    return run


def _subdivided(rows: DataFrame, block: int, r: float) -> DataFrame:
    """(rep, v, copies, cell, own) to the same with ``sub``: a row for each sub-cell of its cell that a vector belongs to (own) or may have a partner in.

    The pivots of a cell are a hash sample of its members, one for each block that it would fill, so a small share of it.
    """
    sizes = rows.groupBy("cell").agg(F.count_if("own").alias("members"), F.count("*").alias("all")).where(F.col("members") > block)
    sizes = written(sizes.select("cell", F.ceil(F.col("members") / block).alias("subs"), F.ceil(F.col("all") / block).alias("chunks")), "large-cells")
    large = rows.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    # members fall into as many slots as there are to be pivots, and the first of each slot by another hash is one
    slot = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("subs"))
    chosen = large.where("own").groupBy("cell", "chunks", slot.alias("slot")).agg(F.min_by("v", F.xxhash64("rep", F.lit(5))).alias("v"))
    pivots = chosen.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "v").toDF("its_cell", "its_chunk", "pivot")

    def run(key, left, right):
        left = left.combine_chunks()
        x, p = _matrix(left["v"].chunk(0)) if left.num_rows else np.zeros((0, 1)), _matrix(right.combine_chunks()["pivot"].chunk(0))
        own = left["own"].to_numpy(zero_copy_only=False)
        # the same order in every chunk
        p = p[np.lexsort(p.T[::-1])]
        between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18))
        at, sub, mine = [], [], []
        for k in range(0, len(x), 2048):
            d2 = np.maximum(2 - 2 * x[k : k + 2048] @ p.T, 0)
            d, home = np.sqrt(d2), d2.argmin(1)
            row = np.arange(len(d))
            near = d[row, home]
            go = (d <= near[:, None] + 2 * r + 1e-7) & ((d2 - near[:, None] ** 2) / (2 * between[home]) <= r + 1e-7)
            member = own[k : k + 2048].astype(bool)
            go &= ~member[:, None] | (np.arange(len(p)) >= home[:, None])
            i, j = np.nonzero(go)
            at.append(i + k)
            sub.append(j)
            mine.append(member[i] & (j == home[i]))
        if not at:
            return pa.table({"rep": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "copies": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "own": pa.array([], pa.bool_()), "sub": pa.array([], pa.int32())})
        where = pa.array(np.concatenate(at))
        taken = left.select(["rep", "v", "copies", "cell"]).take(where)
        return taken.append_column("own", pa.array(np.concatenate(mine))).append_column("sub", pa.array(np.concatenate(sub), pa.int32()))

    names = "rep long, v array<double>, copies long, cell int, own boolean, sub int"
    cut = large.groupBy("cell", "chunk").cogroup(pivots.groupBy("its_cell", "its_chunk")).applyInArrow(run, names)
    rest = rows.join(sizes.select("cell"), "cell", "left_anti").select("rep", "v", "copies", "cell", "own", F.lit(0).alias("sub"))
    return written(cut.unionByName(rest), "sub-cells", sizes)


def links(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    spark, r = vectors.sparkSession, float(np.sqrt(2 - 2 * threshold))
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.when(_usable(v), v).alias("v"))
    rows = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    distinct = written(rows.where("v is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    parts = [_links_of_size(distinct.where(F.size("v") == n), r, threshold, pivots) for (n,) in sorted(distinct.select(F.size("v")).distinct().collect())]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = written(found, "block-links")
    else:
        found = spark.createDataFrame([], "rep long, links long, joined long")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("joined").alias("b"))).withColumnRenamed("node", "rep")
    final = distinct.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(roots, "rep", "left")
    final = written(final.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root")), "vector-links")
    out = rows.select("id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2").join(final, ["h1", "h2"], "left")
    linked = F.when(F.col("id").isNotNull(), F.col("links"))
    return out.select(F.col("id").alias(key), F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"), F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"))


def _links_of_size(distinct: DataFrame, r: float, threshold: float, pivots: int | None) -> DataFrame:
    n, size = distinct.count(), distinct.select(F.size("v")).first()[0]
    block = max(256, BLOCK_BYTES // (8 * size))
    k = pivots or max(1, min(MAX_PIVOTS, n // block))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = F.transform("v", lambda x: x / top)
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    unit = distinct.select("rep", "copies", "h1", scaled.alias("s")).select("rep", F.transform("s", lambda x: x / norm).alias("v"), "copies", "h1")
    chosen = unit.orderBy(F.xxhash64("h1", F.lit(7)), "rep").limit(k).select("v").toArrow()  # at most MAX_PIVOTS rows
    p = _matrix(chosen["v"].combine_chunks())
    unit = unit.drop("h1")
    radii = np.full(len(p), -np.inf)
    for row in _place(unit, p, None, r).groupBy("home").agg(F.max("near").alias("radius")).collect():  # one row per pivot
        radii[row["home"]] = row["radius"]
    placed = written(_place(unit, p, radii, r), "placed-vectors")

    home = placed.select("rep", "v", "copies", F.col("home").alias("cell"), F.lit(True).alias("own"))
    away = placed.select("rep", "v", "copies", F.explode("visits").alias("cell"), F.lit(False).alias("own"))
    rows = _subdivided(home.unionByName(away), block, r)
    discard(placed)

    cell = ["cell", "sub"]
    blocks = rows.where("own").groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("blocks"))
    at_home = rows.where("own").drop("own").join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    among = at_home.select("rep", "v", "copies", *cell, F.explode(F.when(F.col("block") + 1 < F.col("blocks"), F.sequence(F.col("block") + 1, F.col("blocks") - 1))).alias("block"))
    visiting = rows.where(~F.col("own")).drop("own").join(blocks, cell).select("rep", "v", "copies", *cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    guests = among.unionByName(visiting)
    many = guests.groupBy(*cell, "block").agg(F.ceil(F.count("*") / block).alias("visitors"))
    guests = guests.join(many, [*cell, "block"]).withColumn("visitors", F.pmod(F.xxhash64("rep"), F.col("visitors"))).withColumn("own", F.lit(False))
    hosts = at_home.select("rep", "v", "copies", *cell, "block").join(many, [*cell, "block"], "left").withColumn("visitors", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("visitors", F.lit(1)) - 1))).withColumn("own", F.lit(True))
    return hosts.unionByName(guests).groupBy(*cell, "block", "visitors").applyInArrow(_block(threshold), "rep long, links long, joined long")

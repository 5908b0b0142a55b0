"""Merkle manifest of a dataset (operator 11): leaves, roots and proofs by a slot pivot.

Rows of a group stand in their order; every ``fanout`` consecutive nodes make a parent, until one is left, and the groups' roots
make the dataset's root in the same way.  Positions come from range partitions and prefix counts (``operators.ranks``), so
that a group may hold any share of the rows.

One step climbs ``levels`` levels: nodes are grouped by the parent that far above, and conditional aggregates
spread them into fanout ** levels slot columns.  Concatenating the columns of a run hashes its parent; leaving out
a node's own slot gives its siblings.  The way back joins each grouped row (one for that many nodes) with the
proof of its parent and unpivots it, so that whole proofs travel with a fraction of the rows.

Defined results: null and repeated order keys are allowed (nulls first, ties by the leaf itself; equal rows are interchangeable);
a null group is a group, before the others; a lone leaf is the root of its group; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohabit.operators.ranks import ranked

from .common import written

FANOUT, LEVELS = 2, 3
PROOF = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """How a value enters a leaf: ``-`` for null, else its UTF-8 size, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, step: digest(step["l"], h, step["r"]))


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["l"], step["r"])), ""), 256)


class _Pivot:
    """Slot columns of nodes that share an ancestor, and what follows from them."""

    def __init__(self, fanout: int, levels: int) -> None:
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels

    def grouped(self, nodes: DataFrame) -> DataFrame:
        """(g, pos, n, h, ...) to a row for each run of ``width`` nodes: n, and the node (h, ...) of each slot."""
        own = [c for c in nodes.columns if c not in ("g", "pos", "n")]
        slot = F.col("pos") % self.width
        pick = lambda i: F.first(F.when(slot == i, F.struct(*own)), ignorenulls=True).alias(f"s{i}")
        return nodes.groupBy("g", F.floor(F.col("pos") / self.width).alias("pos")).agg(F.max("n").alias("n"), *[pick(i) for i in range(self.width)])

    def hashed(self, grouped: DataFrame) -> DataFrame:
        """Adds the nodes of each level as ``h<level>_<place>``, and the number of levels that the group still climbs."""
        out = grouped.withColumns({f"h0_{i}": F.col(f"s{i}.h") for i in range(self.width)})
        for j in range(1, self.levels + 1):
            run = lambda m: [F.col(f"h{j - 1}_{x}") for x in range(m * self.fanout, (m + 1) * self.fanout)]  # noqa: B023, E731
            out = out.withColumns({f"h{j}_{m}": F.when(run(m)[0].isNotNull(), digest(*[F.coalesce(x, F.lit("")) for x in run(m)])) for m in range(self.width // self.fanout**j)})
        climbs = sum(((F.col("n") > self.fanout**j).cast("int") for j in range(self.levels)), F.lit(0))
        return out.withColumn("climbs", climbs)

    def parents(self, grouped: DataFrame) -> DataFrame:
        tops = F.array(*[F.col(f"h{j}_0") for j in range(self.levels + 1)])
        return self.hashed(grouped).select("g", "pos", F.ceil(F.col("n") / self.width).alias("n"), F.get(tops, F.col("climbs")).alias("h"))

    def _step(self, i: int, j: int) -> Column:
        """Siblings of slot i's ancestor at level j, before and after it."""
        at = i // self.fanout**j
        run = range(at // self.fanout * self.fanout, (at // self.fanout + 1) * self.fanout)
        side = lambda places: F.concat(F.lit(""), *[F.coalesce(F.col(f"h{j}_{x}"), F.lit("")) for x in places])
        return F.struct(side([x for x in run if x < at]).alias("l"), side([x for x in run if x > at]).alias("r"))

    def children(self, grouped: DataFrame, parents: DataFrame) -> DataFrame:
        """Nodes again, each with its proof: its siblings within the run, then the parent's proof."""
        more = [c for c in parents.columns if c not in ("g", "pos", "proof")]
        joined = self.hashed(grouped).join(parents, ["g", "pos"])
        nodes = [F.when(F.col(f"s{i}").isNotNull(), F.struct((F.col("pos") * self.width + i).alias("pos"), F.col(f"s{i}").alias("node"), F.slice(F.array(*[self._step(i, j) for j in range(self.levels)]), F.lit(1), F.col("climbs")).alias("steps"))) for i in range(self.width)]
        flat = joined.select("g", "proof", *more, F.explode(F.array_compact(F.array(*nodes))).alias("x"))
        return flat.select("g", "x.pos", "x.node.*", F.concat("x.steps", "proof").alias("proof"), *more)


def _climb(nodes: DataFrame, pivot: _Pivot) -> tuple[list[DataFrame], DataFrame]:
    """All steps up: the grouped rows of each, and (g, pos, n, h) of the roots."""
    most, grouped = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        grouped.append(written(pivot.grouped(nodes), "slots"))
        nodes, most = pivot.parents(grouped[-1]), -(-most // pivot.width)
        if most == 1:
            return grouped, nodes


def _descend(grouped: Sequence[DataFrame], roots: DataFrame, pivot: _Pivot) -> DataFrame:
    """From (g, pos, proof, ...) of the roots to the nodes of the first step."""
    for k, step in enumerate(reversed(grouped)):
        inner = k + 1 < len(grouped)
        nodes = pivot.children(step, roots)
        roots = nodes.drop("h") if inner else nodes
    return roots


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All columns of ``rows`` (few and small ones, one of them the leaf's hash) with subroot, root and proof.

    ``proof`` holds a step for each level from the leaf to the dataset's root: the siblings before and after the node, concatenated.
    """
    pivot = _Pivot(fanout, levels)
    named = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own")
    leaves = written(rows.select(field(F.col(f"`{group}`")).alias("g"), F.col(f"`{group}`").alias("name"), F.col(f"`{order}`").alias("key"), F.col(f"`{leaf}`").alias("h"), named), "leaves")
    placed = ranked(leaves, ["key", "h"], ["name"], "pos", "n", done=[leaves]).select("g", "pos", "n", "h", "own", "name")
    below, subroots = _climb(placed, pivot)
    names = below[-1].groupBy("g").agg(F.first("s0.name").alias("name")) if len(below) == 1 else placed.select("g", "name").distinct()
    level = written(subroots.select("g", F.col("h")).join(names, "g"), "subroots")
    tops = ranked(level, ["name"], (), "pos", "n").select(F.lit("").alias("g"), "pos", "n", "h", F.struct("g", F.col("h").alias("subroot")).alias("own"))
    above, root = _climb(tops, pivot)
    nothing = F.array().cast(PROOF)
    proven = _descend(above, root.select("g", "pos", nothing.alias("proof"), F.col("h").alias("root")), pivot)
    starts = proven.select("own.g", F.lit(0).cast("long").alias("pos"), "proof", "own.subroot", "root")
    found = _descend(below, starts, pivot)
    taken = {"subroot", "root", "proof"}
    return found.select(*[F.col(f"own.`{c}`") for c in rows.columns if c.lower() not in taken], "subroot", "root", "proof")

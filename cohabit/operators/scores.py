"""Scores of pairs from their host, microbe and shared dataset counts.

Input columns: host_dataset_count, pathogen_dataset_count, both_dataset_count.  Exact tests
run once for each distinct combination of counts and are joined back; hypergeometric tails share the terms of equal host and microbe counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohabit.config import LEAST_P, N_TOTAL, N_UNIVERSE
from cohabit.functions.stats import MarginTails, fisher_two_sided

COUNTS = ["host_dataset_count", "pathogen_dataset_count", "both_dataset_count"]


def _counts() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) for c in COUNTS)


def hypergeom_tails(counts: DataFrame, n_total: int = N_TOTAL) -> DataFrame:
    """Adds log_p = ln P(X >= shared) to distinct counts without nulls.

    Counts of one margin (host, microbe) meet in a task in order, so that each probability of the margin is summed once for all of them.
    """
    h, m, s = _counts()
    possible = (s > F.greatest(F.lit(0), m - (F.lit(n_total) - h))) & (s <= F.least(h, m))
    below = s.cast("decimal(19,0)") * n_total <= m.cast("decimal(19,0)") * h
    side = F.when(~possible, 0).when(below, -1).otherwise(1)
    sided = counts.select(*COUNTS, side.alias("side")).repartition(*COUNTS[:2]).sortWithinPartitions(*COUNTS[:2], "side", -s * F.col("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = MarginTails(n_total)
        for b in batches:
            if len(b):
                white, draws, x, side = (c.to_numpy() for c in b.columns)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.asarray(tails(x, white, draws, side), dtype=np.float64))], names=[*COUNTS, "log_p"])

    return sided.mapInArrow(run, sided.select(*COUNTS, F.lit(0.0).alias("log_p")).schema)


def hypergeom_score(df: DataFrame, n_total: int = N_TOTAL, log_space: bool = False) -> DataFrame:
    """Adds hyp_geo_score = P(X >= shared) (0 becomes the least positive value) and neg_log_p.

    Probabilities below about 1e-308 all get the same neg_log_p, unless ``log_space`` takes it from their logarithm.
    """
    h, m, s = _counts()
    known = df.select(*COUNTS).where(h.isNotNull() & m.isNotNull() & s.isNotNull()).distinct()
    p = F.exp("log_p")
    scored = hypergeom_tails(known, n_total).withColumn("hyp_geo_score", F.when(p == 0, F.lit(LEAST_P)).otherwise(p))
    neg_log_p = -F.col("log_p") / math.log(10) if log_space else -F.log10("hyp_geo_score")
    return df.join(scored.withColumn("neg_log_p", neg_log_p + F.lit(0.0)).drop("log_p"), COUNTS, "left")


def log_odds(df: DataFrame, n_total: int = N_TOTAL) -> DataFrame:
    h, m, s = _counts()
    n = float(n_total)
    return df.withColumns({"fh": h / n, "fp": m / n, "fhp": s / n}).withColumn("log_odds", F.log2((F.col("fhp") + 1 / n) / (F.col("fh") * F.col("fp") + 1 / n)))


def log_odds_local(df: DataFrame) -> DataFrame:
    """The same against the pair's own datasets; null where both counts are 0."""
    h, m, s = _counts()
    n = F.nullif(h + m, F.lit(0)).cast("double")
    shares = df.withColumns({"fh_2": h / n, "fp_2": m / n, "fhp_2": s / n})
    return shares.withColumn("log_odds_2", F.log2((F.col("fhp_2") + 1 / n) / (F.col("fh_2") * F.col("fp_2") + 1 / n)))


def cooccurrence_metrics(df: DataFrame, n_universe: int = N_UNIVERSE) -> DataFrame:
    """Adds a, b, c, d, jaccard, sorensen_dice, ochiai, phi, c_score, the cell shares and mutual_info (bits)."""
    h, m, s = (x.cast("double") for x in _counts())
    a, b, c, d = (F.col(x) for x in "abcd")
    floor0 = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    n = float(n_universe)
    table = df.withColumn("a", s).withColumns({"b": floor0(h - a), "c": floor0(m - a)}).withColumn("d", F.lit(n) - (a + b + c))
    margins = (a + b > 0) & (a + c > 0)
    out = table.withColumns({
        "jaccard": F.when(a + b + c > 0, a / (a + b + c)),
        "sorensen_dice": F.when(2 * a + b + c > 0, 2 * a / (2 * a + b + c)),
        "ochiai": F.when(margins, a / F.sqrt((a + b) * (a + c))),
        "phi": F.when(margins & (b + d > 0) & (c + d > 0), (a * d - b * c) / F.sqrt((a + b) * (a + c) * (b + d) * (c + d))),
        "c_score": (h - a) * (m - a),
        **{f"p_{x}": F.col(x) / n for x in "abcd"},
    })
    p = {x: F.col(f"p_{x}") for x in "abcd"}
    out = out.withColumns({"p_row1": p["a"] + p["b"], "p_row2": p["c"] + p["d"], "p_col1": p["a"] + p["c"], "p_col2": p["b"] + p["d"]})
    cell = lambda x, row, col: F.when(p[x] > 0, p[x] * F.log2(p[x] / (F.col(row) * F.col(col)))).otherwise(0.0)
    return out.withColumn("mutual_info", cell("a", "p_row1", "p_col1") + cell("b", "p_row1", "p_col2") + cell("c", "p_row2", "p_col1") + cell("d", "p_row2", "p_col2"))


def fisher_p(df: DataFrame, n_universe: int | None = None) -> DataFrame:
    """Adds fisher_p; d is b + c, or what is left of ``n_universe``.  Null where a count would be negative."""
    h, m, s = _counts()
    b, c = h - s, m - s
    d = b + c if n_universe is None else F.lit(n_universe) - (s + b + c)
    known = df.select(*COUNTS).where(h.isNotNull() & m.isNotNull() & s.isNotNull()).distinct()
    return df.join(known.withColumn("fisher_p", fisher_two_sided(s, b, c, d)), COUNTS, "left")

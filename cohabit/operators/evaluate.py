"""ROC curves, areas and best cutoffs for every comparison of classes and every threshold combination at once.

Scores are counted, sorted by range over all groups together, and summed up by prefix counts (``ranks``), so a group may hold any number of
pairs: no window or exact median takes a group into one task, and what is kept of a group is a few sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohabit.config import COMPARISONS
from cohabit.operators.ranks import before, join_parts, range_of, sorted_rows
from cohabit.schemas import COMPARISON

COMBO = ["host_threshold", "path_threshold"]
GROUP = ["comparison", *COMBO]


def comparisons(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = COMPARISONS) -> DataFrame:
    return spark.createDataFrame(list(rows), COMPARISON)


def _scored(df: DataFrame, which: Sequence[tuple[str, str, str]], score: str) -> DataFrame:
    """Rows of either class, once for each comparison; ``pos`` is 1 for cases.  NaN counts as missing."""
    c = F.broadcast(comparisons(df.sparkSession, which))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).join(c, F.col("Interaction_type").isin(F.col("pos_class"), F.col("neg_class")))
    return rows.select(*GROUP, F.col(score).cast("double").alias("score"), (F.col("Interaction_type") == F.col("pos_class")).cast("int").alias("pos"))


def _seen(scored: DataFrame) -> DataFrame:
    """One row per group and distinct score, in ascending order: cases (p) and controls (n) at it and up to it, the neighbouring scores, and the group's totals."""
    counts = scored.groupBy(*GROUP, "score").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    rows = sorted_rows(counts, ["score"], GROUP, name="scores").withColumn("_part", range_of())
    # ranges are of even size, whatever the groups are
    line = Window.partitionBy("_part").orderBy("_at")
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p_run": F.sum("p").over(run), "n_run": F.sum("n").over(run), "_up": F.lead(F.struct(*GROUP, "score")).over(line), "_down": F.lag(F.struct(*GROUP, "score")).over(line)})
    parts = rows.groupBy(*GROUP, "_part").agg(F.min(F.col("p_run") - F.col("p")).alias("p_start"), F.min(F.col("n_run") - F.col("n")).alias("n_start"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    order = Window.partitionBy(*GROUP).orderBy("_part")  # a row for each range
    parts = before(parts.withColumns({"after": F.lead("lo").over(order), "earlier": F.lag("hi").over(order)}), GROUP, ["p", "n"]).drop("p", "n", "lo", "hi")
    joined = join_parts(rows, parts, GROUP)
    beside = lambda c: F.when(F.struct(*[F.col(f"{c}.{g}") for g in GROUP]) == F.struct(*GROUP), F.col(f"{c}.score"))
    return joined.select(
        *GROUP, "score", "p", "n", (F.col("p_run") - F.col("p_start") + F.col("p_before")).alias("p_seen"), (F.col("n_run") - F.col("n_start") + F.col("n_before")).alias("n_seen"),
        F.coalesce(beside("_up"), "after").alias("next"), F.coalesce(beside("_down"), "earlier").alias("last"), F.col("p_all").alias("cases"), F.col("n_all").alias("controls"),
    ).where("cases > 0 and controls > 0")


def medians(seen: DataFrame) -> DataFrame:
    """Exact medians of cases and controls of each group: the scores at their middle ranks."""

    def middle(count: str, upto: str, whole: str) -> Column:
        holds = lambda k: (F.col(upto) - F.col(count) <= k) & (k < F.col(upto))
        half = lambda k: F.max(F.when(holds(k), F.col("score")))
        return (half(F.floor((F.col(whole) - 1) / 2)) + half(F.floor(F.col(whole) / 2))) / 2

    return seen.groupBy(*GROUP).agg(middle("p", "p_seen", "cases").alias("case_median"), middle("n", "n_seen", "controls").alias("control_median"))


def _curve(scored: DataFrame) -> DataFrame:
    """One row per group and distinct score, along the direction in which cases score higher (``sign``): counts at it and up to it."""
    seen = _seen(scored)
    sides = medians(seen).select(*GROUP, F.when(F.col("control_median") <= F.col("case_median"), 1).otherwise(-1).alias("sign"))
    up = F.col("sign") == 1
    turned = lambda upto, count, whole: F.when(up, F.col(upto)).otherwise(F.col(whole) - F.col(upto) + F.col(count)).alias(upto)
    return seen.join(sides, GROUP).select(
        *GROUP, "sign", (F.col("score") * F.col("sign")).alias("s"), "p", "n", "cases", "controls",
        turned("p_seen", "p", "cases"), turned("n_seen", "n", "controls"), (F.when(up, F.col("next")).otherwise(F.col("last")) * F.col("sign")).alias("next"),
    )


def class_medians(df: DataFrame, which: Sequence[tuple[str, str, str]] = COMPARISONS, score: str = "log_odds") -> DataFrame:
    """(comparison, thresholds, case_median, control_median) where both classes have scores."""
    return medians(_seen(_scored(df, which, score)))


def _area() -> Column:
    return F.sum(F.col("n") * (F.col("cases") - F.col("p_seen") + F.col("p") / 2)) / F.first(F.col("cases") * F.col("controls"))


def roc_points(df: DataFrame, which: Sequence[tuple[str, str, str]] = (("PHI vs Neg", "PHI-Base", "Negative Control"),), score: str = "log_odds") -> DataFrame:
    """(comparison, thresholds, cutoff, specificity, sensitivity, auc): cutoffs halfway between scores and at both infinities."""
    curve = _curve(_scored(df, which, score))
    sides = curve.groupBy(*GROUP).agg(_area().alias("auc"), F.first("sign").alias("_sign"))
    infinity = F.lit(float("inf"))
    inner = curve.join(sides, GROUP).select(*GROUP, (F.coalesce((F.col("s") + F.col("next")) / 2, infinity) * F.col("sign")).alias("cutoff"), (F.col("n_seen") / F.col("controls")).alias("specificity"), ((F.col("cases") - F.col("p_seen")) / F.col("cases")).alias("sensitivity"), "auc")
    return inner.unionByName(sides.select(*GROUP, (-infinity * F.col("_sign")).alias("cutoff"), F.lit(0.0).alias("specificity"), F.lit(1.0).alias("sensitivity"), "auc"))


def auc_grid(df: DataFrame, which: Sequence[tuple[str, str, str]] = COMPARISONS, score: str = "log_odds", ties: str = "one") -> DataFrame:
    """(comparison, thresholds, auc, n_total, n_correct) for all comparisons and combinations.

    ``n_correct`` is taken at the cutoff with the largest sensitivity + specificity; of several the most
    sensitive one, or all rows with ``ties="all"``.  Groups that lack a class have null auc and n_correct.
    """
    if ties not in ("one", "all"):
        raise ValueError(f"ties {ties!r} is neither 'one' nor 'all'")
    scored = _scored(df, which, score)
    tp, tn = F.col("cases") - F.col("p_seen"), F.col("n_seen")
    points = _curve(scored).select(*GROUP, "p", "n", "p_seen", "cases", "controls", tp.alias("tp"), tn.alias("tn"), (tp * F.col("controls") + tn * F.col("cases")).alias("youden"))
    # the cutoff below all scores, where every case and no control is right, has cases * controls
    start = F.struct((F.first("cases") * F.first("controls")).alias("youden"), F.first("cases").alias("tp"), F.lit(0).cast("long").alias("tn"))
    best = points.groupBy(*GROUP).agg(_area().alias("auc"), F.greatest(F.max(F.struct("youden", "tp", "tn")), start).alias("best"), start.alias("start"))
    if ties == "one":
        top = best.select(*GROUP, "auc", (F.col("best.tp") + F.col("best.tn")).alias("n_correct"))
    else:
        most = best.select(*GROUP, "auc", F.col("best.youden").alias("_most"), "start")
        inner = points.join(most, GROUP).where("youden = _most").select(*GROUP, "auc", (F.col("tp") + F.col("tn")).alias("n_correct"))
        top = inner.unionByName(most.where("start.youden = _most").select(*GROUP, "auc", (F.col("start.tp") + F.col("start.tn")).alias("n_correct")))
    seen = scored.groupBy(*GROUP).agg(F.count("*").alias("n_total"))
    full = df.select(*COMBO).distinct().crossJoin(F.broadcast(comparisons(df.sparkSession, which).select("comparison")))
    return full.join(seen, GROUP, "left").join(top, GROUP, "left").select(*GROUP, "auc", F.coalesce("n_total", F.lit(0)).alias("n_total"), "n_correct")


def auc_summary(df: DataFrame, comparison: tuple[str, str, str] = ("PHI vs Neg", "PHI-Base", "Negative Control"), score: str = "log_odds") -> DataFrame:
    """The grid of a single comparison."""
    return auc_grid(df, (comparison,), score)


def roc_label_text(summary: DataFrame) -> DataFrame:
    """Adds the text that labels a curve: AUC to two decimals, and the number of observations."""
    text = F.concat(F.lit("AUC = "), F.coalesce(F.when(F.col("auc").isNotNull(), F.format_string("%.2f", F.round("auc", 2))), F.lit("NA")), F.lit("\nN = "), F.col("n_total").cast("string"))
    return summary.withColumn("label", text)


def score_histogram(df: DataFrame, score: str = "log_odds", by: str = "Interaction_type", bins: int = 50) -> DataFrame:
    """(by, bin, n): equal-width bins 1 to ``bins`` between the smallest and the largest score."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(by, F.col(score).alias("x"))
    edges = F.broadcast(rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), 1 + F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(1)
    return rows.crossJoin(edges).groupBy(by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))

"""Per-group decision thresholds.

``roc_points``  W2: one-vs-rest ROC curve per (group, class): one point per
                distinct score (descending), cumulative TP/FP counts, collinear
                middle points dropped (both ends kept), then an initial point
                (threshold +inf, 0, 0) added; FPR/TPR by the group's totals.
``group_thresholds`` W3: per (group, class) the threshold of the kept point
                whose FPR is nearest the target (ties: the earlier point, i.e.
                the higher threshold); groups where the class is absent or
                universal keep the default.
``predict_with_thresholds`` K2 + J4: class with the largest p - t (first on
                ties), t from the row's group, the default vector otherwise.

Scale: scores are first reduced to (key, score, tp, fp) by partial
aggregation; running totals come from ``running_sum`` (buckets of the score,
so a hot group is spread over many tasks); the "next point" needed for the
collinearity test is an equi-join on (key, rank + 1), not a whole-group
window; the final pick is a ``min_by`` aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import safe_div
from .joins import bounded
from .ordering import running_sum

INF = float("inf")
SCORE_BUCKETS = 4096


def class_scores(df: DataFrame, group_col: str, label_col: str, probs_col: str,
                 classes: Sequence[int]) -> DataFrame:
    """Long one-vs-rest table (grp, cls, score, pos) for every class.

    Slot c of ``probs_col`` belongs to class code c, as in Spark's probability
    vectors (which have a slot for every code up to the largest)."""
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("nan"))
    cells = F.array(*[F.struct(F.lit(int(c)).alias("cls"),
                               F.get(F.col(probs_col), int(c)).cast("double").alias("score"))
                      for c in classes])
    return (df.select(g.alias("grp"), F.col(label_col).alias("_y"), F.explode(cells).alias("c"))
            .select("grp", "c.cls", "c.score", (F.col("_y") == F.col("c.cls")).cast("long").alias("pos")))


def roc_points(scores: DataFrame, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """(grp, cls, threshold, fps, tps, fpr, tpr) kept ROC points incl. +inf."""
    keys = ["grp", "cls"]
    pts = scores.groupBy(*keys, "score").agg(F.sum("pos").alias("tpc"),
                                             F.sum(1 - F.col("pos")).alias("fpc"))
    bucket = F.floor(-F.col("score") * F.lit(buckets))  # never decreases along score desc
    cum = running_sum(pts, keys, [F.desc("score")],
                      {"tps": F.col("tpc"), "fps": F.col("fpc"), "rk": F.lit(1)}, bucket=bucket)
    nxt = cum.select(*keys, (F.col("rk") - 1).alias("rk"),
                     F.col("tpc").alias("ntpc"), F.col("fpc").alias("nfpc"))
    j = cum.join(nxt, [*keys, "rk"], "left")
    keep = ((F.col("rk") == 1) | F.col("ntpc").isNull() |
            (F.col("ntpc") != F.col("tpc")) | (F.col("nfpc") != F.col("fpc")))
    kept = j.where(keep).select(*keys, F.col("score").alias("threshold"), "fps", "tps")
    totals = pts.groupBy(*keys).agg(F.sum("tpc").alias("tp_total"), F.sum("fpc").alias("fp_total"))
    totals, _ = bounded(totals)
    init = totals.select(*keys, F.lit(INF).alias("threshold"), F.lit(0).cast("long").alias("fps"),
                         F.lit(0).cast("long").alias("tps"))
    allp = kept.unionByName(init).join(totals, keys)
    return allp.select(*keys, "threshold", "fps", "tps",
                       safe_div(F.col("fps"), F.col("fp_total")).alias("fpr"),
                       safe_div(F.col("tps"), F.col("tp_total")).alias("tpr"),
                       "tp_total", "fp_total")


def group_thresholds(scores: DataFrame, classes: Sequence[int], target_fpr: float = 0.1,
                     default: float = 0.5, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """(grp, cls, threshold) for every group x class; default where the
    class is absent or universal in the group."""
    pts = roc_points(scores, buckets).where((F.col("tp_total") > 0) & (F.col("fp_total") > 0))
    order = F.struct(F.abs(F.col("fpr") - F.lit(target_fpr)).alias("d"), (-F.col("threshold")).alias("t"))
    learned = pts.groupBy("grp", "cls").agg(F.min_by("threshold", order).alias("learned"))
    # every group gets every class: one generated row per (group, class)
    cls_arr = F.array(*[F.lit(int(c)) for c in classes])
    grid = scores.select("grp").distinct().select("grp", F.explode(cls_arr).alias("cls"))
    return (grid.join(learned, ["grp", "cls"], "left")
            .select("grp", "cls", F.coalesce("learned", F.lit(float(default))).alias("threshold")))


def threshold_vectors(thresholds: DataFrame, k: int) -> DataFrame:
    """(grp, thr ARRAY<DOUBLE>) ordered by class position."""
    return (thresholds.groupBy("grp")
            .agg(F.sort_array(F.collect_list(F.struct("cls", "threshold"))).alias("_t"))
            .select("grp", F.transform("_t", lambda s: s["threshold"]).alias("thr")))


def argmax_shifted(probs: Column, thr: Column) -> Column:
    """K2: 0-based index of the largest p - t; the first one on ties."""
    d = F.zip_with(probs, thr, lambda p, t: p.cast("double") - t)
    return (F.array_position(d, F.array_max(d)) - 1).cast("int")


def predict_with_thresholds(df: DataFrame, vectors: DataFrame, group_col: str, probs_col: str,
                            k: int, default: float = 0.5, out_col: str = "yhat_thr",
                            classes: Sequence[int] | None = None) -> DataFrame:
    """K2 + J4: join the group's threshold vector (size-checked broadcast),
    default vector for unseen groups or vectors with NaN / wrong length.
    ``classes`` (default 0..k-1) are the codes in the vectors' order; the
    result is a code."""
    codes = list(range(k)) if classes is None else [int(c) for c in classes]
    small, _ = bounded(vectors.select(F.col("grp").alias("_g"), F.col("thr").alias("_thr")))
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("nan"))
    dflt = F.array_repeat(F.lit(float(default)), k)
    thr = F.when(F.col("_thr").isNull() | (F.size("_thr") != k) |
                 F.exists("_thr", lambda t: F.isnan(t)), dflt).otherwise(F.col("_thr"))
    return (df.withColumn("_g", g).join(small, "_g", "left")
            .withColumn("_at", argmax_shifted(F.array(*[F.get(F.col(probs_col), c) for c in codes]), thr))
            .withColumn(out_col, F.get(F.array(*[F.lit(c) for c in codes]), F.col("_at")))
            .drop("_g", "_thr", "_at"))

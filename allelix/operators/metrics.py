"""Evaluation metrics from one confusion cube.

Every metric starts from ``confusion_cube``: one ``groupBy(keys, y, yhat)
.count()`` — map-side partial aggregation, so a hot group costs nothing
extra — and is then derived on that tiny table (at most groups x k x k rows).
Definitions follow the common library conventions: per-class precision
``tp / predicted``, recall ``tp / support``, F1 their harmonic mean, each 0
when its denominator is 0; the label set of a group is the union of its true
and predicted labels; "weighted" averages by support.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import bounded

CUBE_CELLS = 1_000_000


def _keys(group_col: str | None) -> list[str]:
    return [group_col] if group_col else []


def confusion_cube(df: DataFrame, y: str = "y", yhat: str = "yhat",
                   group_col: str | None = None, null_group: str = "nan",
                   max_cells: int = CUBE_CELLS) -> DataFrame:
    """(group?, y, yhat, n) counts.

    The cube is materialised once: after ``take`` proves it has at most
    ``max_cells`` cells it becomes a local relation, so the per-class
    tables derived from it never re-run the scan. A larger cube stays lazy.
    """
    cols = [F.col(y).alias("y"), F.col(yhat).alias("yhat")]
    if group_col:
        cols.insert(0, F.coalesce(F.col(group_col).cast("string"), F.lit(null_group)).alias(group_col))
    cube = df.select(*cols).groupBy(*[c for c in ([group_col] if group_col else [])], "y", "yhat") \
        .agg(F.count(F.lit(1)).alias("n"))
    local, _ = bounded(cube, max_cells)
    return local


def per_class(cube: DataFrame, group_col: str | None = None) -> DataFrame:
    """(group?, cls, tp, predicted, support, precision, recall, f1) over the
    union of true and predicted labels."""
    k = _keys(group_col)
    sup = cube.groupBy(*k, F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cube.groupBy(*k, F.col("yhat").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cube.where(F.col("y") == F.col("yhat")).groupBy(*k, F.col("y").alias("cls")) \
        .agg(F.sum("n").alias("tp"))
    j = sup.join(pred, [*k, "cls"], "full").join(tp, [*k, "cls"], "left")
    j = j.select(*k, "cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                              for c in ("tp", "predicted", "support")])
    prec = F.coalesce(F.col("tp") / F.when(F.col("predicted") != 0, F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.when(F.col("support") != 0, F.col("support")), F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") /
                    F.when((F.col("precision") + F.col("recall")) != 0,
                           F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.withColumn("f1", f1)


def summary(cube: DataFrame, group_col: str | None = None) -> DataFrame:
    """A8 + A11 (+ A12 with a group): n, accuracy, weighted precision /
    recall / F1 per group (or overall)."""
    k = _keys(group_col)
    pc = per_class(cube, group_col)
    s = F.sum("support")
    return pc.groupBy(*k).agg(
        s.cast("long").alias("n"),
        (F.sum("tp") / s).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"))


def group_metrics(df: DataFrame, y: str, yhat: str, group_col: str) -> DataFrame:
    """Per-group accuracy, weighted precision, recall, F1 and count."""
    return summary(confusion_cube(df, y, yhat, group_col), group_col)


def overall_and_group(df: DataFrame, y: str, yhat: str, group_col: str) -> DataFrame:
    """Overall and per-group accuracy in one aggregation
    (``GROUPING SETS ((group), ())``); the overall row has group NULL."""
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("nan")).alias(group_col)
    hit = (F.col(y) == F.col(yhat)).cast("long")
    return (df.select(g, hit.alias("_hit")).rollup(group_col)
            .agg(F.count(F.lit(1)).alias("n"), (F.sum("_hit") / F.count(F.lit(1))).alias("accuracy")))


def accuracy_gap(group_table: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Max - min of a per-group metric, with both extremes."""
    return group_table.agg(
        (F.max(metric) - F.min(metric)).alias("gap"),
        F.max(metric).alias(f"max_{metric}"), F.min(metric).alias(f"min_{metric}"))


def confusion_matrix(df: DataFrame, labels: Sequence[int], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Full labels x labels grid, raw and normalised by true class; rows
    whose true or predicted label is outside ``labels`` are left out."""
    spark = df.sparkSession
    lab = [int(v) for v in labels]
    grid = spark.createDataFrame([(a, b) for a in lab for b in lab], "y INT, yhat INT")
    cube = (df.where(F.col(y).isin(lab) & F.col(yhat).isin(lab))
            .groupBy(F.col(y).cast("int").alias("y"), F.col(yhat).cast("int").alias("yhat"))
            .agg(F.count(F.lit(1)).alias("n")))
    m = F.broadcast(grid).join(cube, ["y", "yhat"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("y"))  # k x k rows: tiny window
    return m.withColumn("n", F.col("n").cast("long")).withColumn(
        "norm", F.coalesce(F.col("n") / F.when(row != 0, row), F.lit(0.0)))


def class_report(df: DataFrame, labels: Sequence[int], names: Sequence[str],
                 y: str = "y", yhat: str = "yhat") -> DataFrame:
    """A10: per-class precision / recall / F1 / support for the given labels,
    plus 'macro avg' and 'weighted avg' rows."""
    spark = df.sparkSession
    cube = confusion_cube(df, y, yhat)
    pc = per_class(cube)
    names_df = spark.createDataFrame([(int(v), n) for v, n in zip(labels, names)], "cls INT, label STRING")
    rows = F.broadcast(names_df).join(pc, "cls", "left").select(
        "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("support", F.lit(0)).cast("long").alias("support"))
    s = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), s.alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"),
                        *[(F.sum(F.col(c) * F.col("support")) / s).alias(c)
                          for c in ("precision", "recall", "f1")], s.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def side_by_side(a: DataFrame, b: DataFrame, key: str, metric: str,
                 names: tuple[str, str] = ("pop_aware", "non_pop")) -> DataFrame:
    """Two per-group tables on a full outer join; a missing side is 0.0."""
    l = a.select(key, F.col(metric).alias(f"{metric}_{names[0]}"))
    r = b.select(key, F.col(metric).alias(f"{metric}_{names[1]}"))
    return l.join(r, key, "full").select(
        key, *[F.coalesce(F.col(f"{metric}_{n}"), F.lit(0.0)).alias(f"{metric}_{n}") for n in names])


def arm_comparison(df: DataFrame, y: str, arms: dict[str, str], group_col: str) -> DataFrame:
    """Per arm (prediction column) accuracy, weighted F1 and max group
    accuracy gap, with the gap reduction against the first arm — from one
    cube per arm, unioned and pivoted on the arm."""
    parts = []
    for arm, col in arms.items():
        cube = confusion_cube(df, y, col, group_col)
        overall = summary(cube.groupBy("y", "yhat").agg(F.sum("n").alias("n")))
        per_g = summary(cube, group_col)
        gap = per_g.agg((F.max("accuracy") - F.min("accuracy")).alias("gap"),
                        F.lit(arm).alias("arm"))
        # both sides are one row per arm: an equi-join on the arm name
        parts.append(overall.select(F.lit(arm).alias("arm"), "accuracy", "f1").join(gap, "arm"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = list(arms)[0]
    base_gap = F.first(F.when(F.col("arm") == first, F.col("gap")), ignorenulls=True).over(
        Window.partitionBy())  # one row per arm: tiny window
    return out.withColumn("gap_reduction", base_gap - F.col("gap"))


def parity_gap(df: DataFrame, yhat: str, group_col: str, positive: int = 1) -> DataFrame:
    """Selection rate P(yhat = positive) per group; gap = max - min."""
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("nan"))
    rates = df.groupBy(g.alias(group_col)).agg(
        F.avg((F.col(yhat) == positive).cast("double")).alias("selection_rate"))
    return rates.agg((F.max("selection_rate") - F.min("selection_rate")).alias("parity_gap"),
                     F.count(F.lit(1)).alias("groups"))

"""Exploratory tables behind the reference's figures.

histogram  A5: equal-width bins over [min, max] of the non-null values, the
               last bin closed; a constant column uses [v - 0.5, v + 0.5].
kde_grid   A6: Gaussian kernel density with Scott's bandwidth
               ``stddev_samp * n^(-1/5)`` on a ``gridsize``-point grid over
               [min, max].
corr_matrix A7: Pearson correlation of every column pair, pairwise-complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _range(df: DataFrame, col: str) -> tuple[float | None, float | None, int]:
    x = F.col(col).cast("double")
    r = df.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                                    F.count(x).alias("n")).first()
    return r["lo"], r["hi"], r["n"]


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n) for all ``bins`` bins (empty bins have n = 0)."""
    lo, hi, n = _range(df, col)
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin INT, lo DOUBLE, hi DOUBLE, n BIGINT")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(edges).join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi))
                    .otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def kde_grid(df: DataFrame, col: str, gridsize: int = 200, bins: int | None = None) -> DataFrame:
    """(i, x, density) on a linear grid over [min, max].

    Exact mode (``bins=None``): rows are first reduced to (distinct value,
    count) by a partial aggregation, then each distinct value contributes to
    every grid point via ``explode(sequence)`` — cost distinct x grid, no
    join. ``bins=B`` first rounds values to B equal bins over the range (cost
    B x grid, for columns with very many distinct values).
    """
    x = F.col(col).cast("double")
    stats = df.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                                        F.count(x).alias("n"), F.stddev_samp(x).alias("sd")).first()
    spark = df.sparkSession
    n, lo, hi, sd = stats["n"], stats["lo"], stats["hi"], stats["sd"]
    if not n or sd is None or sd == 0 or math.isnan(sd):
        return spark.createDataFrame([], "i INT, x DOUBLE, density DOUBLE")
    h = sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (gridsize - 1) if gridsize > 1 else 0.0
    v = x
    if bins:
        w = (hi - lo) / bins
        v = F.lit(lo) + (F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)) + 0.5) * F.lit(w)
    pts = df.where(x.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("i")
    g = F.lit(lo) + F.col("i") * F.lit(step)
    contrib = F.col("_c") * F.exp(-F.pow(g - F.col("_v"), 2) / F.lit(2 * h * h))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return (pts.select("_v", "_c", grid).groupBy("i")
            .agg((F.sum(contrib) * F.lit(norm)).alias("density"))
            .select(F.col("i").cast("int").alias("i"), (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"),
                    "density"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for every ordered pair, pairwise-complete: a row counts for a
    pair where both values are there (null and NaN are missing).

    Each task adds up masked co-moment matrices of its Arrow batches, one matrix
    product per moment; matrices are added like numbers, so a task sends one row
    per pair and the final sums are a partial aggregation. Values are taken about the
    columns' means (one cheap scan before), which keeps the sums exact where
    the means are large. rho is null for a constant column or a pair without rows.
    """
    cols = list(columns)
    k = len(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    known = [F.when(~F.isnan(v), v) for v in x]
    means = df.agg(F.lit(0), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(known)]).first()
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(k)])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) - shift
            there = ~np.isnan(v)
            v = np.where(there, v, 0.0)
            mask = there.astype(float)
            # rows of both, sums and squares of the first where the second is there, products
            total += np.stack([mask.T @ mask, v.T @ mask, (v * v).T @ mask, v.T @ v])
        i, j = np.indices((k, k)).reshape(2, -1)
        n, s, q, p = total.reshape(4, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n), pa.array(s), pa.array(total[1].T.ravel()), pa.array(q),
             pa.array(total[2].T.ravel()), pa.array(p)], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = df.select(*[v.alias(f"c{i}") for i, v in enumerate(known)]).mapInArrow(
        moments, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    var = lambda sq, s: F.col(sq) - F.col(s) * F.col(s) / F.col("n")
    # what is left of a constant column is rounding of its mean
    size = F.element_at(F.array(*[F.lit(float(abs(m))) for m in shift]), F.col("i") + 1)
    size_j = F.element_at(F.array(*[F.lit(float(abs(m))) for m in shift]), F.col("j") + 1)
    spread = lambda v, m: v > F.col("n") * F.pow(m * 1e-12, F.lit(2))
    names = F.array(*[F.lit(c) for c in cols])
    rho = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(var("sxx", "sx") * var("syy", "sy"))
    fit = (F.col("n") > 1) & spread(var("sxx", "sx"), size) & spread(var("syy", "sy"), size_j)
    return sums.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                       F.when(fit, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))

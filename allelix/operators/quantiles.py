"""Exact quantiles by distributed rank selection.

Spark's exact ``percentile`` aggregate keeps a map of every distinct value
and merges it in one task - fine for thousands of rows, not for billions.
``exact_quantiles`` gives the same numbers (linear interpolation between
the order statistics at floor/ceil of ``p * (n - 1)``) with no single-task
step, for all columns in one pass and on one path whatever their size:

1. (column, distinct value, count) by partial aggregation, stored for the
   steps below;
2. ``percentile_approx`` over each column's distinct values cuts them into
   balanced buckets;
3. the buckets' totals (a row per column and bucket) tell which ranks fall
   into which bucket; a bucket without a needed rank (at most 2 per
   probability) is left out;
4. cumulative counts in value order within the other buckets - each distinct
   value covers ranks [end - count, end) - meet their bucket's ranks only, and
   just the values that cover one reach the driver.

NaN and NULL are no values. A column without values gives None.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 64


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact linear-interpolation quantiles of every column expression."""
    probs = [float(p) for p in probs]
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), columns[c].cast("double").alias("v")) for i, c in enumerate(names)])
    counts = cut_lineage(
        df.select(F.explode(cells).alias("s")).select("s.c", "s.v")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    # one row per column: its number of values and the edges of its buckets
    per = {r["c"]: r for r in counts.groupBy("c").agg(
        F.sum("n").alias("n"), F.percentile_approx("v", cuts, 10_000).alias("edges")).collect()}
    if not per:
        return {c: None for c in names}
    ranks = {i: sorted({r for p in probs for r in (math.floor(p * (row["n"] - 1)), math.ceil(p * (row["n"] - 1)))})
             for i, row in per.items()}
    spark = df.sparkSession
    edges = F.broadcast(spark.createDataFrame([(i, [float(e) for e in per[i]["edges"]]) for i in per], "c int, edges array<double>"))
    placed = (counts.join(edges, "c").withColumn("_b", F.size(F.filter("edges", lambda e: e < F.col("v"))))
              .select("c", "v", "n", "_b"))
    # columns x buckets: the buckets that hold a needed rank, where they begin, and the ranks in them
    asked, begin = [], dict.fromkeys(per, 0)
    for r in sorted(placed.groupBy("c", "_b").agg(F.sum("n").alias("n")).collect()):
        c, lo = r["c"], begin[r["c"]]
        begin[c] = hi = lo + r["n"]
        if inside := ranks[c][bisect_left(ranks[c], lo):bisect_left(ranks[c], hi)]:
            asked.append((c, r["_b"], lo, inside))
    few = F.broadcast(spark.createDataFrame(asked, "c int, _b int, lo bigint, ranks array<bigint>"))
    w = Window.partitionBy("c", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = placed.join(few.select("c", "_b"), ["c", "_b"]).withColumn("end", F.sum("n").over(w)).join(few, ["c", "_b"])
    hit = cum.withColumn("end", F.col("lo") + F.col("end")).select("c", "v", F.explode(F.filter(
        "ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))).alias("rank"))
    at = {(r["c"], r["rank"]): r["v"] for r in hit.collect()}
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(names):
        if i not in per:
            out[c] = None
            continue
        qs = []
        for p in probs:
            pos = p * (per[i]["n"] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            v, w = at[i, lo], at[i, hi]
            qs.append(v if v == w else (hi - pos) * v + (pos - lo) * w)  # equal ends stay exact
        out[c] = qs
    return out

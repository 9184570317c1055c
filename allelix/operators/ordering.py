"""Skew-safe running totals within ordered partitions.

``row_number()/sum() over (partition by k order by o)`` puts a whole key into
one task: a key holding a third of the rows would sort in a single task.
``running_sum`` gives the same numbers without that hot task. The caller
passes a *bucket* column: a deterministic function of the row that never
decreases along the order (a hash prefix when the order is a hash, a
quantised score when the order is a score). Then:

1. Within each (k, bucket) a window running sum — a hot key is spread over
   all its buckets, one window partition each.
2. Per (k, bucket) totals (partial aggregation) give a table of at most
   #keys x #buckets rows; a window over it, partitioned by k, gives each
   bucket's offset (all earlier buckets of the key).
3. Offsets are joined back and added. The offset table's size is known only
   at run time, so the join is left to AQE's measured broadcast decision.

Buckets are a pure function of the data, so any recomputation (a lost
executor, a re-used or re-run stage) assigns every row to the same bucket.
The order must be total (end it with a unique key) for a deterministic result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                values: dict[str, Column], bucket: Column) -> DataFrame:
    """Add one running-total column per ``values`` entry (frame: unbounded
    preceding .. current row, ordered by ``order`` within ``keys``)."""
    vnames = {name: f"_v_{i}" for i, name in enumerate(values)}
    base = df.withColumns({vnames[n]: c for n, c in values.items()}).withColumn("_bkt", bucket)
    w_in = (Window.partitionBy(*keys, "_bkt").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = base.withColumns({f"_in_{n}": F.sum(F.col(v)).over(w_in) for n, v in vnames.items()})
    totals = base.groupBy(*keys, "_bkt").agg(
        *[F.sum(F.col(v)).alias(f"_tot_{n}") for n, v in vnames.items()])
    w_off = (Window.partitionBy(*keys).orderBy("_bkt")
             .rowsBetween(Window.unboundedPreceding, -1))
    okeys = [f"_ok_{i}" for i in range(len(keys))]
    offsets = totals.select(*[F.col(k).alias(o) for k, o in zip(keys, okeys)],
                            F.col("_bkt").alias("_obkt"), *[
        F.coalesce(F.sum(f"_tot_{n}").over(w_off), F.lit(0)).alias(f"_off_{n}") for n in vnames])
    cond = F.col("_bkt").eqNullSafe(F.col("_obkt"))
    for k, o in zip(keys, okeys):
        cond = cond & F.col(k).eqNullSafe(F.col(o))  # NULL keys keep their offsets
    out = local.join(offsets, cond, "left")
    out = out.withColumns({n: (F.col(f"_in_{n}") + F.col(f"_off_{n}")) for n in vnames})
    drop = ["_bkt", "_obkt"] + okeys + list(vnames.values()) + [f"_in_{n}" for n in vnames] + \
           [f"_off_{n}" for n in vnames]
    return out.drop(*drop)


def hex_prefix_bucket(hex_col: Column, n_rows: int, rows_per_bucket: int = 2_000_000) -> Column:
    """Bucket for an order by a uniform hex hash: its first L hex digits, with
    L chosen so a key of ``n_rows`` rows gives about ``rows_per_bucket`` each."""
    length = 1
    while n_rows / (16 ** length) > rows_per_bucket and length < 12:
        length += 1
    return F.substring(hex_col, 1, length)

"""Splits and folds: stratified hold-out split (W1), group k-fold (W4),
row -> fold (J7), split contract checks (U3), balanced class weights (M4)."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import bounded, bounded_rows
from .ordering import hex_prefix_bucket, running_sum

NULL_GROUP = "nan"


def _group_col(df: DataFrame, group_col: str | None, null_group: str) -> tuple[DataFrame, str | None]:
    if group_col is None or group_col not in df.columns:
        return df, None
    if null_group == "drop":
        return df.where(F.col(group_col).isNotNull()).withColumn("_grp", F.col(group_col)), "_grp"
    return df.withColumn("_grp", F.coalesce(F.col(group_col).cast("string"), F.lit(NULL_GROUP))), "_grp"


def hash_order(key_col: str, seed: int) -> F.Column:
    """Seeded, layout-independent order key: md5(key | seed) as hex text."""
    return F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.lit(str(seed))))


# a stratum's hashes are counted by their first digits: 16^3 cells a stratum
PREFIX = 3


def _same(left: list[str], right: list[str]) -> F.Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def _quota_rows(hashed: DataFrame, keys: list[str], key_col: str, test_size: float, rows_per_bucket: int) -> DataFrame:
    """(_k0, ..., _tu, _tkey): the hash and key of each stratum's last test row.

    ``hashed`` holds the strata's columns, the key and its hash ``_u``. Cells of
    (stratum, hash prefix) are counted, running counts over the cells tell in
    which one the quota falls, and only that cell's rows are ranked.
    """
    okeys = [f"_k{i}" for i in range(len(keys))]
    cells = (hashed.groupBy(*keys, F.substring("_u", 1, PREFIX).alias("_cell")).agg(F.count(F.lit(1)).alias("_m"))
             .select(*[F.col(k).alias(o) for k, o in zip(keys, okeys)], "_cell", "_m").transform(cut_lineage))
    n = F.sum("_m").over(Window.partitionBy(*okeys))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*okeys).orderBy("_cell")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.least(F.ceil(F.lit(float(test_size)) * F.col("_n")), F.col("_n") - 1)
    wanted = (cells.withColumns({"_n": n, "_before": before}).withColumn("_rest", quota - F.col("_before"))
              .where((F.col("_rest") > 0) & (F.col("_rest") <= F.col("_m")))
              .select(*okeys, "_cell", "_rest", "_m").transform(cut_lineage))
    largest = wanted.agg(F.max("_m")).first()[0] or 0
    at = _same(keys, okeys) & (F.substring("_u", 1, PREFIX) == F.col("_cell"))
    few, _ = bounded(wanted.drop("_m"))
    inside = hashed.join(few, at).select(*okeys, "_rest", "_u", F.col(key_col).alias("_tkey"))
    ranked = running_sum(inside, okeys, [F.col("_u"), F.col("_tkey")], {"_rank": F.lit(1)},
                         bucket=hex_prefix_bucket(F.substring("_u", PREFIX + 1, 12), largest, rows_per_bucket))
    return (ranked.where(F.col("_rank") == F.col("_rest")).select(*okeys, F.col("_u").alias("_tu"), "_tkey")
            .transform(cut_lineage))


def stratified_split(df: DataFrame, *, key_col: str = "variant_id", label_col: str = "target_encoded",
                     group_col: str | None = "population_name", test_size: float = 0.2,
                     seed: int = 42, null_group: str = "keep", flag_col: str = "is_test",
                     rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Per (group, class) stratum of n rows, the first
    ``min(ceil(test_size * n), n - 1)`` rows in seeded hash order are test.

    A stratum of one row therefore stays in train. Without a group column the
    strata are the classes. Same rule and seed -> same split on any cluster
    layout. The hash of each stratum's last test row is selected from the
    key and the strata's columns alone; the rows themselves aren't shuffled
    for it, each is compared with its stratum's value (a row per stratum,
    broadcast up to ``joins.DEFAULT_BROADCAST_ROWS`` strata, else joined by a
    shuffle). Rows of one stratum that repeat a key are on one side, all of them.
    """
    work, g = _group_col(df, group_col, null_group)
    keys = ([g] if g else []) + [label_col]
    hashed = work.select(*keys, F.col(key_col).alias("_key"), hash_order(key_col, seed).alias("_u"))
    last, _ = bounded(_quota_rows(hashed, keys, "_key", test_size, rows_per_bucket))
    okeys = [f"_k{i}" for i in range(len(keys))]
    u = hash_order(key_col, seed)
    first = (u < F.col("_tu")) | ((u == F.col("_tu")) & F.coalesce(F.col(key_col) <= F.col("_tkey"),
                                                                  F.col(key_col).isNull()))
    out = (work.join(last, _same(keys, okeys), "left")
           .withColumn(flag_col, F.coalesce(first, F.lit(False)))
           .drop("_tu", "_tkey", *okeys))
    return out.drop("_grp") if g else out


def train_test(split_df: DataFrame, flag_col: str = "is_test") -> tuple[DataFrame, DataFrame]:
    return (split_df.where(~F.col(flag_col)).drop(flag_col),
            split_df.where(F.col(flag_col)).drop(flag_col))


def group_folds(df: DataFrame, group_col: str = "population_name", k: int = 5,
                null_group: str = "keep") -> DataFrame:
    """Group k-fold assignment table (group, n, fold).

    Groups sorted by size (desc, then name) each go to the currently lightest
    fold (first on ties); no group is in two folds; fewer groups than folds
    is an error. The greedy pass is sequential by its definition: it streams
    the sorted group sizes (a row per group, never the data) through one task
    that keeps a heap of k loads.
    """
    work, g = _group_col(df, group_col, null_group)
    if g is None:
        raise ValueError("group_folds needs a group column")
    sizes = cut_lineage(work.groupBy(F.col(g).alias("grp")).agg(F.count(F.lit(1)).alias("n")))
    n_groups = sizes.count()
    if n_groups < k:
        raise ValueError(f"cannot make {k} group folds from {n_groups} groups")

    def greedy(batches):
        loads = [(0, f) for f in range(k)]
        for pdf in batches:
            folds = []
            for n in pdf["n"]:
                load, fold = loads[0]
                heapq.heapreplace(loads, (load + int(n), fold))
                folds.append(fold)
            yield pdf.assign(fold=folds)

    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("n"), "grp")
    return cut_lineage(ordered.mapInPandas(greedy, "grp string, n bigint, fold int"))


def assign_folds(df: DataFrame, folds: DataFrame, group_col: str = "population_name",
                 fold_col: str = "fold", null_group: str = "keep") -> DataFrame:
    """Row -> fold through its group (size-checked broadcast of the table)."""
    work, g = _group_col(df, group_col, null_group)
    small, _ = bounded(folds.select(F.col("grp").alias("_grp"), F.col("fold").alias(fold_col)))
    return work.join(small, "_grp", "left").drop("_grp")


def balanced_weights(df: DataFrame, label_col: str = "target_encoded",
                     weight_col: str = "weight") -> DataFrame:
    """M4: weight = n / (k * n_class), from one partial aggregation of classes."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    rows = bounded_rows(counts, 10_000, "class table")
    total = sum(r["_nc"] for r in rows)
    k = len(rows)
    if not rows:
        return df.withColumn(weight_col, F.lit(None).cast("double"))
    expr = None
    for r in rows:
        w = F.lit(total / (k * r["_nc"]))
        cond = F.col(label_col).eqNullSafe(F.lit(r[label_col]))
        expr = F.when(cond, w) if expr is None else expr.when(cond, w)
    return df.withColumn(weight_col, expr.cast("double"))


def split_contract(df: DataFrame, split_df: DataFrame, key_col: str = "variant_id",
                   flag_col: str = "is_test") -> dict:
    """Train ∪ test = input and train ∩ test = ∅, as counts (0 = holds)."""
    train, test = train_test(split_df, flag_col)
    keys_in = df.select(key_col)
    both = train.select(key_col).unionByName(test.select(key_col))
    return {
        "missing": keys_in.exceptAll(both).count(),
        "extra": both.exceptAll(keys_in).count(),
        "overlap": train.select(key_col).intersect(test.select(key_col)).count(),
    }

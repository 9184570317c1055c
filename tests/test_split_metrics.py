"""Splits, folds, running totals (W1, W4, J7, U3) and metrics."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from allelix.operators import metrics as met
from allelix.operators import split as spl
from allelix.operators.ordering import running_sum


def _keyed(spark, strata):
    rows = []
    for g, y, n in strata:
        rows += [(f"{g}-{y}-{i}", g, y) for i in range(n)]
    return spark.createDataFrame(rows, "variant_id STRING, population_name STRING, target_encoded INT")


def test_g7_split_strata(spark):
    df = _keyed(spark, [("a", 0, 1), ("a", 1, 2), ("b", 0, 5), (None, 1, 10)])
    out = spl.stratified_split(df, test_size=0.2, seed=42)
    c = {(r.population_name, r.target_encoded): r.t for r in
         out.groupBy("population_name", "target_encoded").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert c[("a", 0)] == 0          # a stratum of one stays in train
    assert c[("a", 1)] == 1          # ceil(0.4) = 1, below n - 1 = 1
    assert c[("b", 0)] == 1          # ceil(1.0) = 1
    assert c[(None, 1)] == 2         # NULL group kept as its own group
    dropped = spl.stratified_split(df, null_group="drop")
    assert dropped.count() == 8


def test_split_without_group_column(spark):
    df = _keyed(spark, [("a", 0, 10), ("b", 1, 10)]).drop("population_name")
    out = spl.stratified_split(df, group_col=None)
    assert out.where("is_test").count() == 4


def test_u3_split_contract_and_repartition_invariance(spark):
    df = _keyed(spark, [("a", 0, 50), ("a", 1, 37), ("b", 0, 13), ("b", 2, 101)])
    s1 = spl.stratified_split(df, seed=7)
    assert spl.split_contract(df, s1) == {"missing": 0, "extra": 0, "overlap": 0}
    s2 = spl.stratified_split(df.repartition(13, "variant_id"), seed=7)
    a = {r.variant_id for r in s1.where("is_test").collect()}
    b = {r.variant_id for r in s2.where("is_test").collect()}
    assert a == b
    assert {r.variant_id for r in spl.stratified_split(df, seed=8).where("is_test").collect()} != a


@pytest.mark.parametrize("n", [1, 2, 3, 40, 9000])
def test_split_equals_row_number_with_a_hot_stratum(spark, n):
    df = _keyed(spark, [("hot", 0, n), ("a", 1, 7), (None, None, 11)])
    out = spl.stratified_split(df, seed=5, rows_per_bucket=1)
    w = Window.partitionBy("population_name", "target_encoded")
    want = (df.withColumn("u", spl.hash_order("variant_id", 5))
            .withColumn("rn", F.row_number().over(w.orderBy("u", "variant_id")))
            .withColumn("n", F.count(F.lit(1)).over(w))
            .where(F.col("rn") <= F.least(F.ceil(F.lit(0.2) * F.col("n")), F.col("n") - 1)))
    assert out.count() == df.count() and out.columns == [*df.columns, "is_test"]
    assert out.where("is_test").select(df.columns).exceptAll(want.select(df.columns)).count() == 0
    assert out.where("is_test").count() == want.count()


def test_split_shuffles_no_feature_columns(spark):
    df = _keyed(spark, [("a", 0, 50), ("b", 1, 37)]).withColumn("wide", F.repeat("variant_id", 10))
    plan = spl.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_split_of_an_empty_table_and_repeated_keys(spark):
    empty = _keyed(spark, [("a", 0, 1)]).where("false")
    assert spl.stratified_split(empty).count() == 0
    df = _keyed(spark, [("a", 0, 20)])
    twice = spl.stratified_split(df.unionByName(df))
    sides = twice.groupBy("variant_id").agg(F.countDistinct("is_test").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.k == 1 and r.n == 2 for r in sides)


def test_running_sum_matches_row_number_with_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, id INT, v INT")
    bucket = F.floor(F.col("v") / 10)
    got = running_sum(df, ["k"], [F.col("v"), F.col("id")], {"rk": F.lit(1), "cs": F.col("v")}, bucket)
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "ref_cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    j = got.join(ref, ["k", "id", "v"])
    assert j.count() == 3000
    assert j.where("rk != rn OR cs != ref_cs").count() == 0


def test_g8_group_folds(spark):
    rows = [(g, i) for g, n in (("a", 10), ("b", 10), ("c", 10), ("d", 10), ("e", 10), ("f", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "population_name STRING, i INT")
    folds = {r.grp: r.fold for r in spl.group_folds(df, k=5).collect()}
    assert sorted(folds.values()) == [0, 0, 1, 2, 3, 4]
    assert [folds[g] for g in "abcde"] == [0, 1, 2, 3, 4] and folds["f"] == 0
    assigned = spl.assign_folds(df, spl.group_folds(df, k=5))
    # no group in two folds
    assert assigned.groupBy("population_name").agg(F.countDistinct("fold").alias("d")).where("d > 1").count() == 0
    with pytest.raises(ValueError):
        spl.group_folds(df.where("population_name IN ('a','b','c','d')"), k=5)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "target_encoded INT")
    w = sorted(r.weight for r in spl.balanced_weights(df).collect())
    assert w == [4 / 6, 4 / 6, 4 / 6, 2.0]


def test_g5_metrics_edges(spark):
    # group g1: class 2 never predicted; class 1 never true; group g2: one class
    rows = [("g1", 0, 0), ("g1", 0, 1), ("g1", 2, 0), ("g1", 0, 0), ("g2", 1, 1), ("g2", 1, 1), ("g2", 5, 1)]
    df = spark.createDataFrame(rows, "grp STRING, y INT, yhat INT")
    s = {r.grp: r for r in met.group_metrics(df, "y", "yhat", "grp").collect()}
    # g1: labels {0,1,2}; class 0: tp 2, pred 3, sup 3 -> p 2/3 r 2/3; class 2: p 0 r 0
    assert abs(s["g1"].accuracy - 0.5) < 1e-12
    assert abs(s["g1"].precision - (2 / 3 * 3) / 4) < 1e-12
    assert abs(s["g1"].recall - s["g1"].accuracy) < 1e-12          # weighted recall = accuracy
    cm = met.confusion_matrix(df, [0, 1, 2])
    assert cm.agg(F.sum("n")).first()[0] == 6                       # label 5 left out
    assert {(r.y, r.yhat): r.n for r in cm.collect()}[(0, 0)] == 2
    rep = {r.label: r for r in met.class_report(df, [0, 1, 2], ["b", "p", "u"]).collect()}
    assert rep["u"].precision == 0.0 and rep["u"].support == 1
    gap = met.accuracy_gap(met.group_metrics(df, "y", "yhat", "grp").select("grp", "accuracy")).first()
    assert abs(gap.gap - (2 / 3 - 0.5)) < 1e-12
    both = {r.grp: r.accuracy for r in met.overall_and_group(df, "y", "yhat", "grp").collect()}
    assert abs(both[None] - 4 / 7) < 1e-12


def test_parity_gap(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1)], "g STRING, yhat INT")
    assert met.parity_gap(df, "yhat", "g").first().parity_gap == 0.5


def test_side_by_side_missing_is_zero(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.7)], "pop STRING, accuracy DOUBLE")
    b = spark.createDataFrame([("y", 0.6), ("z", 0.9)], "pop STRING, accuracy DOUBLE")
    got = {r.pop: (r.accuracy_pop_aware, r.accuracy_non_pop) for r in met.side_by_side(a, b, "pop", "accuracy").collect()}
    assert got == {"x": (0.5, 0.0), "y": (0.7, 0.6), "z": (0.0, 0.9)}

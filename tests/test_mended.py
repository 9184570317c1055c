"""Cases that an earlier version answered wrongly."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from allelix.operators import features as feat
from allelix.operators import rules
from allelix.operators import split as spl
from allelix.operators import thresholds as thr
from allelix.operators import transform as tf
from allelix.plans import models as M
from allelix.plans import search as S
from allelix.sources import readers
from allelix.sources.stages import fingerprint


def test_score_of_own_population(spark):
    rows = spark.createDataFrame([("v", "a"), ("v", "b"), ("v", None)], "h string, pop string")
    codes = spark.createDataFrame([("v", "a", "PVS1"), ("v", "b", "BA1")], "h string, pop string, code string")
    scores = rules.score_long(codes, factors={})
    out = {r["pop"]: r["acmg_score"] for r in rules.attach_scores(rows, scores).collect()}
    each = {r["pop"]: r["acmg_score"] for r in scores.collect()}
    assert out == {"a": each["a"], "b": each["b"], None: 0.0} and out["a"] != out["b"]


def test_binary_logistic_penalty(spark):
    data = [(float(i % 2), 1.0, Vectors.dense([(i % 7) / 3.0 + (i % 2)])) for i in range(60)]
    x = spark.createDataFrame(data, ["label", "weight", "features"])
    est = M.make_estimator("LogisticRegression", [0, 1], 60.0, C=0.1)
    model = est.fit(x)
    assert model.coefficientMatrix.numRows == 1
    # gradient of sum(w * loss) + |b|^2 / (2 C) at the solution
    b, a = model.coefficients[0], model.intercept
    grad = sum((1 / (1 + 2.718281828459045 ** -(a + b * v[0])) - y) * v[0] for y, _, v in data) + b / 0.1
    assert abs(grad) < 1e-2


def test_fingerprint_is_of_content(spark, scratch):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert fingerprint(a) != fingerprint(b)
    assert fingerprint(a) == fingerprint(a.repartition(3))
    a.write.parquet(f"{scratch}/t")
    assert fingerprint(spark.read.parquet(f"{scratch}/t")) == fingerprint(a)
    b.write.mode("overwrite").parquet(f"{scratch}/t")
    assert fingerprint(spark.read.parquet(f"{scratch}/t")) == fingerprint(b)


def test_csv_columns_and_markers(spark, scratch):
    import os
    os.makedirs(f"{scratch}/one")
    with open(f"{scratch}/one/a.csv", "w") as f:
        f.write("gene,region,allele_freq\ng1,NA,NaN\nNaN,r1,0.5\n")
    rows = {tuple(r) for r in readers.read_variants_csv(spark, f"{scratch}/one").collect()}
    assert rows == {("g1", None, None), (None, "r1", 0.5)}
    with open(f"{scratch}/one/b.csv", "w") as f:
        f.write("allele_freq,gene,region\n0.2,g2,r2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_variants_csv(spark, f"{scratch}/one", columns=["gene", "region", "allele_freq"]).collect()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0), ("b", None)], "population_name string, allele_freq double")
    out = {(r[0], r[1]) for r in feat.GroupMeans().fit(df).transform(df).select(
        "population_name", "pop_allele_freq_mean").collect()}
    assert out == {("a", 1.0), ("b", 3.0)}


@pytest.mark.parametrize("distinct", [200, 20_000])
def test_robust_scale_has_one_path(spark, distinct):
    df = spark.range(distinct).select(F.col("id").cast("double").alias("x")).unionByName(
        spark.createDataFrame([(float("nan"),)], "x double"))
    row = df
    for st in tf.fit_numeric(df, ["x"], "robust"):
        row = st.transform(row)
    got = {r["x"]: r["num_x"] for r in row.where("x in (0, 100)").collect()}
    mid, iqr = (distinct - 1) / 2, None
    import numpy as np
    v = np.append(np.arange(distinct, dtype=float), mid)  # the NaN is imputed by the mean
    q25, q50, q75 = np.quantile(v, [0.25, 0.5, 0.75])
    iqr = q75 - q25
    for x, z in got.items():
        assert z == pytest.approx((x - q50) / iqr)


def test_class_codes_are_not_positions(spark):
    probs = [0.1, 0.0, 0.9]  # slots of codes 0, 1, 2
    df = spark.createDataFrame([("g", 2, probs)], "grp string, y int, probs array<double>")
    got = {r["cls"]: r["score"] for r in thr.class_scores(df, "grp", "y", "probs", [0, 2]).collect()}
    assert got == {0: 0.1, 2: 0.9}
    vec = spark.createDataFrame([("g", [0.5, 0.5])], "grp string, thr array<double>")
    out = thr.predict_with_thresholds(df, vec, "grp", "probs", 2, classes=[0, 2]).first()
    assert out["yhat_thr"] == 2


def _parity(spark, parts):
    rows = [(["a", "b", "c", None][i % 4], i % 3 == 0, float(i % 11)) for i in range(240)]
    df = spark.createDataFrame(rows, "grp string, y boolean, x double").select(
        "grp", F.col("y").cast("int").alias("y"), "x").repartition(parts)
    spec = M.ArmSpec(model="LogisticRegression", group_col="grp", label_col="y", numeric=("x",),
                     categorical=("grp",), sequence=(), params={"maxIter": 20})
    return [tuple(round(v, 6) for v in r) for r in S.parity_search(df, spec, grid_size=4)[1].orderBy("grid_point").collect()]


def test_parity_search_does_not_depend_on_layout(spark):
    assert _parity(spark, 2) == _parity(spark, 7)


def test_features_are_fitted_once_per_fold(spark, monkeypatch):
    rows = [("g%d" % (i % 6), i % 2, float(i % 13), "c%d" % (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "population_name string, target_encoded int, allele_freq double, gene string")
    calls = []
    real = M.fit_features
    monkeypatch.setattr(M, "fit_features", lambda train, spec: calls.append(1) or real(train, spec))
    small = {"LogisticRegression": {"maxIter": 5}}
    S.cv_grid(df, scalers=("none", "standard"), models=("LogisticRegression",), k=3, params=small)
    assert len(calls) == 6  # scalers x folds
    calls.clear()
    table = S.random_search(df, "LogisticRegression", grid={"C": [0.1, 1.0], "maxIter": [5]}, k=3)[0]
    assert len(calls) == 4  # folds, and the refit of the best
    assert table.count() == 6


def test_folds_of_many_groups(spark):
    df = spark.range(30_000).select(F.concat(F.lit("g"), F.col("id") % 15_000).alias("population_name"))
    folds = spl.group_folds(df, k=4)
    assert folds.count() == 15_000
    n = [r["n"] for r in folds.groupBy("fold").agg(F.sum("n").alias("n")).collect()]
    assert len(n) == 4 and max(n) - min(n) <= 2


def test_correlation_is_pairwise_complete(spark):
    """Null and NaN are missing, large means cost no digits, a constant column has no correlation."""
    import numpy as np

    from allelix.operators.profile import corr_matrix
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = 0.5 * a + rng.normal(size=200)
    rows = [(None if i % 7 == 0 else float(x), float("nan") if i % 5 == 0 else float(y), 1e9 + float(y), 0.1)
            for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, big double, same double").repartition(5)
    got = {(r.a, r.b): r.rho for r in corr_matrix(df, ["a", "b", "big", "same"]).collect()}
    both = [i for i in range(200) if i % 7 and i % 5]
    some = [i for i in range(200) if i % 7]
    assert abs(got["a", "b"] - np.corrcoef(a[both], b[both])[0, 1]) < 1e-9 and got["a", "b"] == got["b", "a"]
    assert abs(got["big", "a"] - np.corrcoef(a[some], b[some])[0, 1]) < 1e-5
    assert abs(got["a", "a"] - 1) < 1e-12 and got["same", "a"] is None and got["same", "same"] is None
    assert corr_matrix(df.where("false"), ["a", "b"]).where("rho is not null").count() == 0


def test_parity_search_fits_in_few_tasks(spark, monkeypatch):
    """Every iteration of a fit sends a result per task to the driver: tasks follow the rows, not the table's pieces."""
    seen, fit_on = [], S.M.fit_on
    monkeypatch.setattr(S.M, "fit_on", lambda x, *a, **k: seen.append((x.rdd.getNumPartitions(), x.count())) or fit_on(x, *a, **k))
    rows = [("a" if i % 3 else "b", float(i % 7), int(i % 5 > 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, v double, y int").repartition(97)
    spec = S.M.ArmSpec(model="LogisticRegression", group_col="grp", label_col="y", numeric=("v",), categorical=("grp",), sequence=())
    S.parity_search(df, spec, grid_size=2)
    assert [n for _, n in seen] == [600, 600]
    assert all(p <= spark.sparkContext.defaultParallelism for p, _ in seen)


def test_quantiles_ask_each_bucket_for_its_own_ranks(spark, monkeypatch):
    import numpy as np
    from allelix.operators import quantiles
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3_000), np.zeros(700), np.ones(5)])
    df = spark.createDataFrame([(float(x), None if i % 3 else float(x)) for i, x in enumerate(v)], "v double, w double")
    longest, plain = [], F.broadcast
    monkeypatch.setattr(quantiles.F, "broadcast", lambda t: longest.append(
        t.agg(F.max(F.size("ranks"))).first()[0] if "ranks" in t.columns else 0) or plain(t))
    probs = [i / 999 for i in range(1000)]
    got = quantiles.exact_quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs)
    assert np.allclose(got["v"], np.quantile(v, probs)) and np.allclose(got["w"], np.quantile(v[::3], probs))
    assert max(longest) < 500  # of the up to 2,000 ranks


def test_base_view_is_not_stored_beside_the_views(spark):
    from pyspark import StorageLevel
    from allelix import fixtures as fx
    assert fx._base(spark, "/root/testdata/sf0.001").storageLevel == StorageLevel.NONE


def test_fitting_an_arm_derives_its_rows_once(spark):
    """Every statistic, the class weights and the matrix read rows that are kept."""
    from allelix.plans import models as M
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    df = spark.range(300).select(
        counted((F.col("id") % 7).cast("double")).alias("allele_count"), F.concat(F.lit("g"), F.col("id") % 3).alias("gene"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("p"), F.col("id") % 4)).alias("population_name"),
        (F.col("id") % 11 / 10).alias("allele_freq"), F.lit("ACGT").alias("allele"), (F.col("id") % 2).cast("int").alias("target_encoded"),
        F.col("id").alias("variant_id"))
    spec = M.ArmSpec(model="LogisticRegression", params={"maxIter": 3})
    assert set(M.arm_rows(df, spec).columns) == set(df.columns) - {"variant_id"}
    fitted = M.fit_arm(df, spec, [0, 1])
    assert made.value == 300
    assert len(fitted.transform(df).select("variant_id", "yhat").collect()) == 300


def test_feature_pipeline_has_a_code_stage_of_its_own_and_puts_the_text_together_once(spark):
    from allelix.operators import transform as tf
    from allelix.plans import models as M
    df = spark.range(40, numPartitions=4).select(
        F.concat(F.lit("A"), F.col("id")).alias("allele"), (F.col("id") % 2).cast("int").alias("target_encoded"), F.col("id").alias("n"))
    plan = tf.char_count_stage(["a", "1", "'"], ["allele"]).transform(df)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert {(r.n, r.seq_0, r.seq_1, r.seq_2) for r in plan.collect()} == {(i, 1.0, float(str(i).count("1")), 0.0) for i in range(40)}
    feats = M.fit_features(df, M.ArmSpec(model="LogisticRegression", numeric=("n",), categorical=(), sequence=("allele",)))
    out = feats.transform(df)
    assert "Coalesce" in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == 4 and out.count() == 40


def test_logistic_arm_reads_rows_of_one_task_spread_over_the_cores(spark, monkeypatch):
    """F10 (refit), F17: a file of one row group is one task, and each pass of the fit would wait for it."""
    from allelix.plans import models as M
    seen, fit_on = [], M.fit_on
    monkeypatch.setattr(M, "FEW_ROWS", 100, raising=False)
    monkeypatch.setattr(M, "fit_on", lambda x, *a, **k: seen.append(
        [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]) or fit_on(x, *a, **k))
    df = spark.range(800, numPartitions=1).select(
        (F.col("id") % 7).cast("double").alias("allele_count"), F.concat(F.lit("g"), F.col("id") % 3).alias("gene"),
        (F.col("id") % 5 % 2).cast("int").alias("target_encoded"))
    spec = M.ArmSpec(model="LogisticRegression", params={"maxIter": 5})
    fitted = M.fit_arm(df, spec, [0, 1])
    cores = spark.sparkContext.defaultParallelism
    assert sum(seen[0]) == 800 and (cores == 1 or max(seen[0]) <= 1.5 * 800 / cores + 1)
    monkeypatch.setattr(M, "FEW_ROWS", 10_000)
    plain = M.fit_arm(df, spec, [0, 1])
    assert seen[1] == [800]
    assert abs(fitted.model.coefficients.toArray() - plain.model.coefficients.toArray()).max() < 1e-6
    M.kept_evenly(df.where("false")).unpersist()


def test_cv_grid_query_runs_every_family_with_every_scaler(spark, monkeypatch):
    from allelix import queries as Q
    monkeypatch.setattr(Q, "_model_rows", lambda spark, sf_dir: spark.createDataFrame(
        [("g%d" % (i % 6), i % 3) for i in range(60)], "population_name string, target_encoded int"))
    monkeypatch.setattr(S, "_fold_rows", lambda data, f, specs, classes, seed, ptext=None: [
        ("pop_aware", s.model, s.scaler, "{}", f, 1, 1.0, 1.0, 1.0, 1.0) for s in specs])
    got = sorted((r["scaler"], r["model"], r["fold"]) for r in Q.q_cv_grid(spark, "").collect())
    assert got == sorted((s, m, f) for s in S.SCALERS for m in S.CV_MODELS for f in range(5))

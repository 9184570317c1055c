"""Thresholds (W2, W3, K2, J4), rule scores (R1-R3), scaling (T1-T4), profile."""

import math
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from allelix import fixtures as fx
from allelix.functions.rules import blend, rule_score
from allelix.functions.stats import norm_ppf
from allelix.operators import profile as prof
from allelix.operators import rules as rul
from allelix.operators import thresholds as thr
from allelix.operators import transform as tf
from allelix.operators.text import CharCounts
from tests.conftest import SF01


def _scores(spark, rows):
    df = spark.createDataFrame(rows, "g STRING, y INT, p0 DOUBLE, p1 DOUBLE").withColumn("probs", F.array("p0", "p1"))
    return df, thr.class_scores(df, "g", "y", "probs", [0, 1])


def test_g6_thresholds(spark):
    rows = [("one", 1, 0.2, 0.8), ("one", 1, 0.4, 0.6),                       # one class only
            ("tied", 0, 0.5, 0.5), ("tied", 1, 0.5, 0.5), ("tied", 0, 0.5, 0.5)]
    rows += [("lin", i % 2, 1 - i / 20, i / 20) for i in range(20)]            # alternating labels
    rows += [("col", 1 if i < 5 else 0, 1 - (9 - i) / 10, (9 - i) / 10) for i in range(10)]  # two straight runs
    df, sc = _scores(spark, rows)
    t = {(r.grp, r.cls): r.threshold for r in thr.group_thresholds(sc, [0, 1]).collect()}
    assert t[("one", 0)] == 0.5 and t[("one", 1)] == 0.5
    assert t[("tied", 1)] == math.inf                                         # nearest point is the +inf start
    pts = thr.roc_points(sc).where("grp = 'lin' AND cls = 1").orderBy(F.desc("threshold")).collect()
    assert pts[0].threshold == math.inf and pts[0].fps == 0
    assert len(pts) == 21                                                    # no collinear points here
    col = thr.roc_points(sc).where("grp = 'col' AND cls = 1").orderBy(F.desc("threshold")).collect()
    assert [(r.fps, r.tps) for r in col] == [(0, 0), (0, 1), (0, 5), (5, 5)]   # middle of each run dropped
    # FPR invariant: the pick is no farther from 0.1 than any kept point
    best = t[("lin", 1)]
    d_best = [abs(p.fpr - 0.1) for p in pts if p.threshold == best][0]
    assert all(d_best <= abs(p.fpr - 0.1) + 1e-15 for p in pts)


def test_fixture_p_nation0_class1_pick(spark):
    p = fx.predictions(spark, SF01).withColumn("probs", F.array("p0", "p1", "p2"))
    sc = thr.class_scores(p, "pop", "y", "probs", [0, 1, 2])
    pts = thr.roc_points(sc).where("grp = 'NATION_0' AND cls = 1")
    t = thr.group_thresholds(sc, [0, 1, 2]).where("grp = 'NATION_0' AND cls = 1").first().threshold
    assert abs(t - 0.447) < 1e-12
    assert pts.where(F.col("threshold") == t).first().fps == 81


def test_k2_ties_and_infinity(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [math.inf, math.inf]),
                                ([0.2, 0.8], [0.1, math.inf])], "p ARRAY<DOUBLE>, t ARRAY<DOUBLE>")
    got = [r.k for r in df.select(thr.argmax_shifted(F.col("p"), F.col("t")).alias("k")).collect()]
    assert got == [0, 0, 0]


def test_predict_default_for_unseen_group(spark):
    vec = spark.createDataFrame([("a", [0.9, 0.1])], "grp STRING, thr ARRAY<DOUBLE>")
    df = spark.createDataFrame([("a", [0.6, 0.4]), ("z", [0.6, 0.4])], "g STRING, probs ARRAY<DOUBLE>")
    got = {r.g: r.yhat_thr for r in thr.predict_with_thresholds(df, vec, "g", "probs", 2).collect()}
    assert got == {"a": 1, "z": 0}


def test_g10_rule_scores(spark):
    f = {"P1": {"PM2": 1.2, "PP1": 1.1}}
    df = spark.createDataFrame([([], "P1"), (["PM2", "PM2"], "P1"), (["XX"], "P1"), (["PVS1", "PM2"], "Q"),
                                (["PVS1", "PVS1", "PS1", "PS2", "PS3"], None), (["BA1", "BA1", "BS1", "BS2", "BS3"], "P1"),
                                (None, "P1")], "codes ARRAY<STRING>, pop STRING")
    got = [r.s for r in df.select(rule_score(F.col("codes"), F.col("pop"), factors=f).alias("s")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 4 * 1.2 * 1.2) < 1e-12 and got[2] == 0.0
    assert got[3] == 10.0 and got[4] == 28.0 and got[5] == -28.0 and got[6] == 0.0
    b = df.select(blend(F.lit(1.0), F.lit(28.0)).alias("u"), blend(F.lit(1.0), F.lit(28.0), clip=True).alias("c")).first()
    assert b.u > 1.0 and abs(b.c - 1.0) < 1e-12


def test_long_and_array_rule_scores_agree(spark):
    codes = fx.rule_codes(spark, "/root/testdata/sf0.001")
    facs = {"NATION_0": {"PM2": 1.2, "PP1": 1.1}, "NATION_1": {"PM2": 0.9, "PP1": 1.0}}
    long_form = rul.score_long(codes, factors=facs)
    arr = (codes.groupBy("h", "pop").agg(F.collect_list("code").alias("codes"))
           .select("h", "pop", rule_score(F.col("codes"), F.col("pop"), factors=facs).alias("a")))
    j = long_form.join(arr, ["h", "pop"])
    assert j.count() == long_form.count()
    assert j.where(F.abs(F.col("acmg_score") - F.col("a")) > 1e-9).count() == 0


def test_g9_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 2.0), (None, 5.0, 2.0), (5.0, 5.0, 9.0)],
                               "x DOUBLE, const DOUBLE, zi DOUBLE")
    std = PipelineModel(stages=tf.fit_numeric(df, ["x", "const"], "standard")).transform(df).collect()
    mean = 8 / 3
    sd = math.sqrt(((1 - mean) ** 2 + (2 - mean) ** 2 + 0 + (5 - mean) ** 2) / 4)
    assert abs(std[0].num_x - (1 - mean) / sd) < 1e-12 and std[2].num_x == 0.0
    assert all(r.num_const == 0.0 for r in std)                           # zero variance -> /1
    rob = PipelineModel(stages=tf.fit_numeric(df, ["zi"], "robust")).transform(df).collect()
    assert [r.num_zi for r in rob][:3] == [0.0, 0.0, 0.0]                 # zero IQR -> /1
    q = PipelineModel(stages=tf.fit_numeric(df, ["x"], "quantile")).transform(df).collect()
    assert q[0].num_x < q[1].num_x < q[3].num_x and abs(q[3].num_x - tf.CLIP_HI) < 1e-9


def test_norm_ppf_accuracy(spark):
    ps = [1e-7, 0.001, 0.02425, 0.1, 0.5, 0.8, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p DOUBLE").select("p", norm_ppf("p").alias("z"))
    for r in df.collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-8 * max(1, abs(r.z))


def test_quantile_knots_plateaus():
    knots, lo, hi = tf.quantile_knots([0.0, 1.0, 1.0, 1.0, 2.0])
    assert knots == [0.0, 1.0, 2.0] and lo == [0.0, 0.25, 1.0] and hi == [0.0, 0.75, 1.0]


def test_g11_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "gene STRING")
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "gene STRING")
    from pyspark.ml import Pipeline
    model = Pipeline(stages=tf.categorical_stages(["gene"])).fit(train)
    rows = model.transform(test).collect()
    size = rows[0].cat_gene.size
    assert size == 3                                         # a, b, missing
    assert rows[1].cat_gene.numNonzeros() == 0               # unseen -> all zeros
    assert rows[2].cat_gene.numNonzeros() == 1               # NULL -> 'missing' category


def test_char_counts(spark):
    df = spark.createDataFrame([("k1", "AcG", "A/t"), ("k2", None, None)], "k STRING, allele STRING, allele_string STRING")
    cc = CharCounts().fit(df)
    assert cc.vocabulary == ["/", "a", "c", "g", "t"]
    got = {(r.k, r.ch): r.n for r in cc.long_form(df, "k").collect()}
    assert got == {("k1", "/"): 1, ("k1", "a"): 2, ("k1", "c"): 1, ("k1", "g"): 1, ("k1", "t"): 1}


def test_histogram_and_kde(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 2, 10]], "x DOUBLE")
    h = prof.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [3, 1, 0, 0, 1] and h[-1].hi == 10.0
    const = prof.histogram(spark.createDataFrame([(3.0,)], "x DOUBLE"), "x", 50).collect()
    assert sum(r.n for r in const) == 1
    k = prof.kde_grid(df, "x", 11).orderBy("i").collect()
    area = sum(r.density for r in k) * 1.0
    assert len(k) == 11 and 0.5 < area < 1.1
    kb = prof.kde_grid(df, "x", 11, bins=1000).orderBy("i").collect()
    assert all(abs(a.density - b.density) < 1e-3 for a, b in zip(k, kb))

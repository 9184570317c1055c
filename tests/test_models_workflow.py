"""Model tests (M1-M7, S7, S8), stage store resume (S4-S6, M14), plans."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from allelix import fixtures as fx
from allelix.operators import features as feat
from allelix.operators import split as spl
from allelix.plans import models as M
from allelix.plans import search as S
from allelix.plans import workflow as W
from allelix.queries import labelled_features
from allelix.sources.stages import StageStore
from allelix.streaming import scoring
from tests.conftest import SF001, SF01


@pytest.fixture(scope="module")
def learnable(spark):
    v = fx.variants_learnable(spark, SF01)
    df = feat.interaction_terms(feat.sequence_features(v)).persist()
    s = spl.stratified_split(df, label_col="y_learn", seed=42)
    tr, te = spl.train_test(s)
    return tr.persist(), te.persist()


def test_forest_beats_majority_and_is_reproducible(spark, learnable):
    tr, te = learnable
    spec = M.ArmSpec(population_aware=False, model="RandomForest", label_col="y_learn",
                     params={"numTrees": 20, "maxDepth": 6})
    a = M.evaluate_arm(M.fit_arm(tr, spec, [0, 1]), te, label_col="y_learn")["overall"].first()
    majority = te.agg(F.avg("y_learn")).first()[0]
    majority = max(majority, 1 - majority)
    assert a.accuracy > majority + 0.1
    b = M.evaluate_arm(M.fit_arm(tr, spec, [0, 1]), te, label_col="y_learn")["overall"].first()
    assert a.accuracy == b.accuracy and a.f1 == b.f1


def test_logistic_and_boosted_learn(spark, learnable):
    tr, te = learnable
    for model, params in (("LogisticRegression", {"maxIter": 100}), ("Boosted", {"maxIter": 10})):
        spec = M.ArmSpec(population_aware=True, model=model, label_col="y_learn", params=params)
        acc = M.evaluate_arm(M.fit_arm(tr, spec, [0, 1]), te, label_col="y_learn")["overall"].first().accuracy
        assert acc > 0.6, model


def test_three_class_boosted_has_probabilities(spark):
    df = labelled_features(spark, SF001)
    tr, te = spl.train_test(spl.stratified_split(df))
    spec = M.ArmSpec(population_aware=False, model="Boosted", params={"maxIter": 3, "maxDepth": 3})
    fitted = M.fit_arm(tr, spec, [0, 1, 2])
    out = fitted.transform(te).select("probs", "yhat").collect()
    assert all(abs(sum(r.probs) - 1.0) < 1e-9 and len(r.probs) == 3 for r in out)
    assert {r.yhat for r in out} <= {0, 1, 2}


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError):
        M.make_estimator("Nope", [0, 1])


def test_save_load_scores_equal_and_stream(spark, learnable, scratch):
    tr, te = learnable
    spec = M.ArmSpec(population_aware=True, model="LogisticRegression", label_col="y_learn",
                     params={"maxIter": 50})
    fitted = M.fit_arm(tr, spec, [0, 1])
    path = f"{scratch}/arm"
    M.save_arm(fitted, path)
    loaded = M.load_arm(path)
    a = fitted.transform(te).select("variant_id", F.element_at("probs", 2).alias("p"))
    b = loaded.transform(te).select("variant_id", F.element_at("probs", 2).alias("q"))
    j = a.join(b, "variant_id")
    assert j.count() == te.count() and j.where(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    # the same saved arm scores a stream of raw variant files
    src = f"{scratch}/in"
    raw = fx.variants(spark, SF001).withColumn("codes", F.array(F.lit("PM2"), F.lit("PP1")))
    raw.write.parquet(src)
    q = scoring.score_stream(spark, path, src, raw.schema, f"{scratch}/out", f"{scratch}/ck")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{scratch}/out")
    assert got.count() == raw.count()
    r = got.where(F.col("hybrid_score").isNull()).count()
    assert r == 0
    # raw rows score as before saving, in a batch and on the stream: the arm carries its group means
    before = fitted.transform(scoring.prepare_rows(raw)).select("variant_id", F.element_at("probs", 2).alias("p")).distinct()
    batch = scoring.score(loaded, raw).select("variant_id", F.col("prob_pathogenic").alias("q")).distinct()
    for after in (batch, got.select("variant_id", F.col("prob_pathogenic").alias("q")).distinct()):
        j = before.join(after, "variant_id").where(F.abs(F.col("p") - F.col("q")) <= 1e-12)
        assert j.select("variant_id").distinct().count() == raw.select("variant_id").distinct().count()


def test_group_threshold_classifier(spark):
    df = labelled_features(spark, SF001)
    tr, te = spl.train_test(spl.stratified_split(df))
    spec = M.ArmSpec(population_aware=True, model="FairnessAware", params={"numTrees": 10, "maxDepth": 5})
    fitted = M.fit_arm(tr, spec, [0, 1, 2])
    n_groups = tr.select(F.coalesce("population_name", F.lit("nan"))).distinct().count()
    assert len(fitted.model.vectors) == n_groups and all(len(v[1]) == 3 for v in fitted.model.vectors)
    assert fitted.transform(te).count() == te.count()


def test_feature_importance_names(spark, learnable):
    tr, te = learnable
    spec = M.ArmSpec(population_aware=False, model="RandomForest", label_col="y_learn",
                     params={"numTrees": 10, "maxDepth": 5})
    fitted = M.fit_arm(tr, spec, [0, 1])
    top = M.feature_importance(fitted, te, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance and all(r.name for r in top)


def test_workflow_resume_computes_nothing(spark, scratch):
    v = fx.variants(spark, SF001)
    cfg = W.RunConfig(base=f"{scratch}/stages", stages=("eda", "cv", "holdout", "export"),
                      scalers=("standard",), cv_models=("LogisticRegression",),
                      model_params={"LogisticRegression": {"maxIter": 20}})
    first = W.run(spark, v, cfg)
    assert {r.stage: r.reused for r in first["_reused"].collect()} == \
        {"eda": False, "eda_histogram": False, "cv": False, "split": False, "holdout": False,
         "holdout_populations": False, "holdout_confusion": False, "export": False}
    second = W.run(spark, v, cfg)
    assert all(r.reused for r in second["_reused"].collect())
    assert second["cv"].count() == 1 and second["holdout"].count() == 2
    # a binary run never reads the three-class results
    store = StageStore(spark, cfg.base)
    assert store.latest_path("eda", "binary", "") is None
    assert glob.glob(f"{scratch}/stages/models/*")


def test_parity_search_on_documents(spark):
    docs = fx.documents_labelled(spark, SF01)
    spec = M.ArmSpec(population_aware=True, model="LogisticRegression", group_col="grp", label_col="y",
                     numeric=("n_chars",), categorical=("grp",), sequence=(), params={"maxIter": 30})
    model, table = S.parity_search(docs, spec, grid_size=5)
    assert table.count() == 5
    assert model.transform(docs).count() == docs.count()


def test_no_python_udf_and_broadcasts_in_plans(spark):
    qs = entry_mod.queries()
    for name in ("group_mean_ratio", "stratified_split", "group_metrics", "threshold_predict", "acmg_hybrid"):
        plan = qs[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    plan = qs["group_mean_ratio"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_entry_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and df.columns == ["population_name", "mapped_target", "n", "mean_freq_rel",
                                             "mean_gc", "mean_len"]
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert os.path.exists(SF001)

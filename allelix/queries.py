"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's test tables through a fixture view (which only
re-labels rows into the operator's input schema) and then runs the library's
own operator on the whole view. Computed columns are aliased to the names the
oracle SQL in ``oracles.py`` uses; doubles are rounded to 6 places only at
the final projection, for a stable cross-engine comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import features as feat
from .operators import labels as lab
from .sources.readers import coerce_numeric


def _r(c, nd: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, nd)


def _rounded(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every DOUBLE column (presentation only)."""
    return df.select(*[(_r(f.name, nd).alias(f.name) if f.dataType.typeName() == "double"
                        else F.col(f.name)) for f in df.schema.fields])


def labelled_features(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """Fixture V -> labels -> sequence features -> population features."""
    v = fx.variants(spark, sf_dir)
    df = lab.prepare_target(v, binary=binary)
    df = feat.sequence_features(df)
    return feat.population_features(df)


# ---------------------------------------------------------------- round 1 slice
def q_population_profile(spark, sf_dir):
    """Flagship: class mix and mean relative frequency / GC share per population."""
    df = labelled_features(spark, sf_dir)
    out = (df.groupBy("population_name", "mapped_target")
           .agg(F.count(F.lit(1)).alias("n"),
                F.avg("allele_freq_rel").alias("mean_freq_rel"),
                F.avg("allele_GC_content").alias("mean_gc"),
                F.avg("allele_length").alias("mean_len")))
    return _rounded(out)


def q_label_map(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return lab.prepare_target(v).select("variant_id", "clinical_significance",
                                        "mapped_target", "target_encoded")


def q_label_binary(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return lab.prepare_target(v, binary=True).select("variant_id", "mapped_target",
                                                     "target_encoded")


def q_class_distribution(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return _rounded(lab.class_distribution(lab.prepare_target(v)))


def q_class_counts(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return lab.class_counts(lab.prepare_target(v, binary=True), binary=True)


def q_sequence_features(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    out = feat.sequence_features(v)
    return _rounded(out.select("variant_id", "allele", "allele_length", "allele_A_count",
                               "allele_C_count", "allele_G_count", "allele_T_count",
                               "allele_GC_content"))


def q_numeric_coerce(spark, sf_dir):
    # stand-in for a CSV read without inference: the numeric columns as text,
    # with missing frequencies spelled as text
    v = fx.variants(spark, sf_dir).select(
        "variant_id",
        F.coalesce(F.col("allele_freq").cast("string"), F.lit("not available")).alias("allele_freq"),
        F.col("allele_count").cast("string").alias("allele_count"),
        F.col("sample_size").cast("string").alias("sample_size"),
        F.col("position").cast("string").alias("position"))
    return coerce_numeric(v)


def q_interaction_terms(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return feat.interaction_terms(v).select("variant_id", "pop_consequence", "pop_gene")


def q_group_mean_ratio(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    return _rounded(df.select("variant_id", "population_name", "allele_freq",
                              "pop_allele_freq_mean", "allele_freq_rel"))


def q_column_roles(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    return feat.column_role_profile(df, population_aware=True)


def q_arm_projection(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    out = feat.drop_label_columns(feat.arm_projection(df))
    return _rounded(out)


def q_group_flags(spark, sf_dir):
    df = lab.prepare_target(fx.variants(spark, sf_dir))
    return feat.group_size_flags(df.withColumn("grp", F.coalesce("population_name", F.lit("nan"))),
                                 "grp", "target_encoded")


QUERIES = {
    "population_profile": q_population_profile,
    "label_map": q_label_map,
    "label_binary": q_label_binary,
    "class_distribution": q_class_distribution,
    "class_counts": q_class_counts,
    "sequence_features": q_sequence_features,
    "numeric_coerce": q_numeric_coerce,
    "interaction_terms": q_interaction_terms,
    "group_mean_ratio": q_group_mean_ratio,
    "column_roles": q_column_roles,
    "arm_projection": q_arm_projection,
    "group_flags": q_group_flags,
}


# ---------------------------------------------------------------- splits and folds
from .operators import split as spl  # noqa: E402


def _labelled(spark, sf_dir):
    return lab.prepare_target(fx.variants(spark, sf_dir))


def q_stratified_split(spark, sf_dir):
    df = _labelled(spark, sf_dir).select("variant_id", "population_name", "target_encoded")
    return spl.stratified_split(df, test_size=0.2, seed=42)


def q_split_sizes(spark, sf_dir):
    """train/test sizes per side after the split."""
    df = _labelled(spark, sf_dir).select("variant_id", "population_name", "target_encoded")
    s = spl.stratified_split(df, test_size=0.2, seed=42)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def q_group_kfold(spark, sf_dir):
    return spl.group_folds(_labelled(spark, sf_dir), "population_name", k=5)


def q_fold_assign(spark, sf_dir):
    df = _labelled(spark, sf_dir).select("variant_id", "population_name")
    folds = spl.group_folds(_labelled(spark, sf_dir), "population_name", k=5)
    return spl.assign_folds(df, folds, "population_name")


def q_balanced_weights(spark, sf_dir):
    df = _labelled(spark, sf_dir).select("variant_id", "target_encoded")
    return _rounded(spl.balanced_weights(df))


QUERIES.update({
    "stratified_split": q_stratified_split,
    "split_sizes": q_split_sizes,
    "group_kfold": q_group_kfold,
    "fold_assign": q_fold_assign,
    "balanced_weights": q_balanced_weights,
})


# ---------------------------------------------------------------- metrics (fixture P)
from .operators import metrics as met  # noqa: E402
from .operators import profile as prof  # noqa: E402
from .operators import rules as rul  # noqa: E402
from .operators.text import CharCounts  # noqa: E402


def q_confusion_matrix(spark, sf_dir):
    return _rounded(met.confusion_matrix(fx.predictions(spark, sf_dir), [0, 1, 2]))


def q_class_report(spark, sf_dir):
    return _rounded(met.class_report(fx.predictions(spark, sf_dir), [0, 1, 2],
                                     ["benign", "pathogenic", "uncertain"]))


def q_weighted_metrics(spark, sf_dir):
    return _rounded(met.summary(met.confusion_cube(fx.predictions(spark, sf_dir))))


def q_group_metrics(spark, sf_dir):
    return _rounded(met.group_metrics(fx.predictions(spark, sf_dir), "y", "yhat", "pop"))


def q_overall_and_group_accuracy(spark, sf_dir):
    return _rounded(met.overall_and_group(fx.predictions(spark, sf_dir), "y", "yhat", "pop"))


def q_accuracy_gap(spark, sf_dir):
    g = met.group_metrics(fx.predictions(spark, sf_dir), "y", "yhat", "pop")
    return _rounded(met.accuracy_gap(g.select("pop", "accuracy")))


def q_arm_side_by_side(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    a = met.group_metrics(p, "y", "yhat", "pop")
    b = met.group_metrics(p, "y", "yhat2", "pop")
    return _rounded(met.side_by_side(a, b, "pop", "accuracy"))


def q_arm_comparison(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return _rounded(met.arm_comparison(p, "y", {"pop_aware": "yhat", "non_pop": "yhat2"}, "pop"))


def q_parity_gap(spark, sf_dir):
    return _rounded(met.parity_gap(fx.predictions(spark, sf_dir), "yhat", "pop", positive=1))


# ---------------------------------------------------------------- profile (fixture V)
NUMERIC_PROFILE = ["allele_freq", "allele_count", "sample_size", "position", "allele_length",
                   "allele_A_count", "allele_C_count", "allele_G_count", "allele_T_count",
                   "allele_GC_content", "allele_freq_rel"]


def q_histogram50(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    return _rounded(prof.histogram(df, "allele_count", 50))


def q_kde_grid(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    return _rounded(prof.kde_grid(df, "allele_freq", 200))


def q_corr_matrix(spark, sf_dir):
    df = labelled_features(spark, sf_dir)
    return _rounded(prof.corr_matrix(df, NUMERIC_PROFILE))


# ---------------------------------------------------------------- rule scores (fixture C)
# population factors for the fixture's population names (parameters)
FIXTURE_FACTORS = {"NATION_0": {"PM2": 1.2, "PP1": 1.1}, "NATION_1": {"PM2": 0.9, "PP1": 1.0}}


def _scores(spark, sf_dir):
    return rul.score_long(fx.rule_codes(spark, sf_dir), "h", "pop", "code", factors=FIXTURE_FACTORS)


def q_acmg_score(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir))


def q_acmg_blend(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).select("h", "pop", F.col("p1").alias("prob"))
    out = rul.blend_scores(rul.attach_scores(p, _scores(spark, sf_dir)), "prob").drop("pop")
    return _rounded(out)


def q_acmg_hybrid(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).select("h", "pop", "p1")
    out = rul.hybrid_scores(rul.attach_scores(p, _scores(spark, sf_dir)), "p1")
    return _rounded(out.select("h", "prob_pathogenic", "acmg_raw", "acmg_norm", "hybrid_score"))


# ---------------------------------------------------------------- pathways, characters
# gene -> pathways table for the fixture's gene names (a parameter)
FIXTURE_PATHWAYS = {
    "Brand#11": ["DNA repair", "Cell cycle"],
    "Brand#12": ["DNA repair", "Cancer pathways"],
    "Brand#23": ["Metabolic pathways", "Pentose phosphate pathway"],
    "Brand#35": ["Metabolic pathways"],
}
FIXTURE_IMPORTANCE = {"DNA repair": 1.5, "Metabolic pathways": 0.5}


def q_pathway_features(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    out = feat.pathway_features(v, FIXTURE_PATHWAYS, FIXTURE_IMPORTANCE)
    return out.select("variant_id", *[c for c in out.columns if c.startswith("pathway_")])


def q_char_counts_long(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    cc = CharCounts().fit(v)
    return cc.long_form(v, "variant_id")


QUERIES.update({
    "confusion_matrix": q_confusion_matrix,
    "class_report": q_class_report,
    "weighted_metrics": q_weighted_metrics,
    "group_metrics": q_group_metrics,
    "overall_and_group_accuracy": q_overall_and_group_accuracy,
    "accuracy_gap": q_accuracy_gap,
    "arm_side_by_side": q_arm_side_by_side,
    "arm_comparison": q_arm_comparison,
    "parity_gap": q_parity_gap,
    "histogram50": q_histogram50,
    "kde_grid": q_kde_grid,
    "corr_matrix": q_corr_matrix,
    "acmg_score": q_acmg_score,
    "acmg_blend": q_acmg_blend,
    "acmg_hybrid": q_acmg_hybrid,
    "pathway_features": q_pathway_features,
    "char_counts_long": q_char_counts_long,
})


# ---------------------------------------------------------------- thresholds (fixture P)
from .operators import thresholds as thr  # noqa: E402


def _p_scores(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).withColumn("probs", F.array("p0", "p1", "p2"))
    return p, thr.class_scores(p, "pop", "y", "probs", [0, 1, 2])


def q_roc_points(spark, sf_dir):
    _, sc = _p_scores(spark, sf_dir)
    return _rounded(thr.roc_points(sc).drop("tp_total", "fp_total"))


def q_group_thresholds(spark, sf_dir):
    _, sc = _p_scores(spark, sf_dir)
    return _rounded(thr.group_thresholds(sc, [0, 1, 2]))


def q_threshold_predict(spark, sf_dir):
    p, sc = _p_scores(spark, sf_dir)
    vec = thr.threshold_vectors(thr.group_thresholds(sc, [0, 1, 2]), 3)
    return thr.predict_with_thresholds(p, vec, "pop", "probs", 3).select("h", "pop", "yhat_thr")


QUERIES.update({
    "roc_points": q_roc_points,
    "group_thresholds": q_group_thresholds,
    "threshold_predict": q_threshold_predict,
})


# ---------------------------------------------------------------- scaling (fixture V)
from pyspark.ml import PipelineModel  # noqa: E402

from .operators import transform as tf  # noqa: E402

SCALE_COLS = ["allele_freq", "allele_count", "allele_GC_content"]


def _scaled(spark, sf_dir, scaler, cols=SCALE_COLS, keep=None):
    df = labelled_features(spark, sf_dir)
    stages = tf.fit_numeric(df, cols, scaler)
    out = PipelineModel(stages=stages).transform(df)
    return out.select("variant_id", *(keep or [f"num_{c}" for c in cols]))


def q_impute_standard_scale(spark, sf_dir):
    return _rounded(_scaled(spark, sf_dir, "standard"))


def q_impute_only(spark, sf_dir):
    return _rounded(_scaled(spark, sf_dir, "none"))


def q_robust_scale(spark, sf_dir):
    return _rounded(_scaled(spark, sf_dir, "robust"))


def q_quantile_rank(spark, sf_dir):
    cols = ["allele_freq", "sample_size"]
    return _rounded(_scaled(spark, sf_dir, "quantile", cols, keep=[f"_rank_{c}" for c in cols]))


QUERIES.update({
    "impute_standard_scale": q_impute_standard_scale,
    "impute_only": q_impute_only,
    "robust_scale": q_robust_scale,
    "quantile_rank": q_quantile_rank,
})


# ---------------------------------------------------------------- metric tables (fixture P)
from .plans import search as srch  # noqa: E402


def fold_metric_table(spark, sf_dir):
    """Per (model, scaler, fold) metrics of three predictors over fixture P.

    Folds are group k-fold on the population (W4 + J7); the predictors are
    P's argmax (``argmax``), its coarse argmax (``coarse``) and the
    per-group threshold rule learned on P (``group_threshold``, W2/W3/K2);
    the scaler axis records probabilities as given (``none``) or rounded to
    two places before the argmax (``rounded``).
    """
    p, sc = _p_scores(spark, sf_dir)
    vec = thr.threshold_vectors(thr.group_thresholds(sc, [0, 1, 2]), 3)
    p = thr.predict_with_thresholds(p, vec, "pop", "probs", 3)
    rounded = F.transform("probs", lambda x: F.round(x, 2))
    p = p.withColumn("yhat_r", thr.argmax_shifted(rounded, F.array_repeat(F.lit(0.0), 3)))
    folds = spl.group_folds(p, "pop", 5)
    p = spl.assign_folds(p, folds, "pop")
    preds = {("argmax", "none"): "yhat", ("coarse", "none"): "yhat2",
             ("group_threshold", "none"): "yhat_thr", ("argmax", "rounded"): "yhat_r"}
    parts = []
    for (model, scaler), col in preds.items():
        cube = met.confusion_cube(p.select("y", F.col(col).alias("yhat"), F.col("fold").cast("string")
                                           .alias("fold")), "y", "yhat", "fold")
        s = met.summary(cube, "fold")
        parts.append(s.select(F.lit("pop_aware").alias("arm"), F.lit(model).alias("model"),
                              F.lit(scaler).alias("scaler"), F.lit(f"model={model}").alias("params"),
                              F.col("fold").cast("int").alias("fold"), "n", "accuracy",
                              "precision", "recall", "f1"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def q_cv_summary(spark, sf_dir):
    return _rounded(srch.cv_summary(fold_metric_table(spark, sf_dir)))


def q_model_scaler_grid(spark, sf_dir):
    s = srch.cv_summary(fold_metric_table(spark, sf_dir))
    return _rounded(srch.model_scaler_grid(s, ("none", "rounded")))


def q_best_params(spark, sf_dir):
    return _rounded(srch.best_params(fold_metric_table(spark, sf_dir), key_cols=("scaler",)))


def q_best_model(spark, sf_dir):
    t = fold_metric_table(spark, sf_dir).groupBy("arm", "model", "scaler").agg(
        F.avg("accuracy").alias("accuracy"))
    return _rounded(srch.best_model(t))


QUERIES.update({
    "cv_summary": q_cv_summary,
    "model_scaler_grid": q_model_scaler_grid,
    "best_params": q_best_params,
    "best_model": q_best_model,
})


# ---------------------------------------------------------------- model fits (rows-only)
import uuid  # noqa: E402

from .plans import models as mdl  # noqa: E402
from .session import checkpoint_dir  # noqa: E402


def _scratch(spark, prefix):
    """A fresh path under the shared checkpoint folder (Spark creates it)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{prefix}{uuid.uuid4().hex}"


def _split_features(spark, sf_dir, binary=False):
    """The split of rows without group means: each arm learns them on its training side."""
    s = spl.stratified_split(_model_rows(spark, sf_dir, binary), seed=42)
    return spl.train_test(s)


def _model_rows(spark, sf_dir, binary=False):
    return feat.interaction_terms(feat.sequence_features(
        lab.prepare_target(fx.variants(spark, sf_dir), binary=binary)))


def _arm_groups(train, test, spec, classes):
    fitted = mdl.fit_arm(train, spec, classes)
    ev = mdl.evaluate_arm(fitted, test)
    return _rounded(ev["groups"])


def q_fit_forest(spark, sf_dir):
    """M1 + M7: population-aware forest arm, per-population hold-out metrics."""
    tr, te = _split_features(spark, sf_dir)
    return _arm_groups(tr, te, mdl.ArmSpec(population_aware=True, model="RandomForest"), [0, 1, 2])


def q_fit_boosted(spark, sf_dir):
    """M2 + M7: boosted trees on the binary task (pathogenic vs not), per-population metrics."""
    tr, te = _split_features(spark, sf_dir, binary=True)
    return _arm_groups(tr, te, mdl.ArmSpec(population_aware=True, model="Boosted"), [0, 1])


def q_fit_logistic(spark, sf_dir):
    """M3 + M7: population-agnostic logistic arm, per-population metrics."""
    tr, te = _split_features(spark, sf_dir)
    return _arm_groups(tr, te, mdl.ArmSpec(population_aware=False, model="LogisticRegression"), [0, 1, 2])


def q_feature_importance(spark, sf_dir):
    """K1 + J6: top-20 forest feature importances with names."""
    tr, te = _split_features(spark, sf_dir)
    fitted = mdl.fit_arm(tr, mdl.ArmSpec(population_aware=False, model="RandomForest"), [0, 1, 2])
    return _rounded(mdl.feature_importance(fitted, te, 20))


def q_score_saved_model(spark, sf_dir):
    """S7 + S8: fit, save, load, then score the hold-out rows with the loaded model."""
    tr, te = _split_features(spark, sf_dir)
    fitted = mdl.fit_arm(tr, mdl.ArmSpec(population_aware=False, model="LogisticRegression"), [0, 1, 2])
    path = _scratch(spark, "arm-")
    mdl.save_arm(fitted, path)
    loaded = mdl.load_arm(path)
    out = loaded.transform(te).select("variant_id", "yhat", F.element_at("probs", 2).alias("prob_pathogenic"))
    return _rounded(out)


def q_cv_grid(spark, sf_dir):
    """M8: group 5-fold CV of all four model families with all four scalers, per-fold metrics."""
    return _rounded(srch.cv_grid(_model_rows(spark, sf_dir), k=5, parallelism=4))


def q_random_search(spark, sf_dir):
    """Seeded random search over the logistic grid (C x penalty; its six
    combinations are fewer than the 20 draws, so all are tried), group 5-fold CV on the whole training
    part, refit of the best; per-(params, fold) metrics."""
    tr, _ = _split_features(spark, sf_dir)
    table, _, _, _ = srch.random_search(tr, "LogisticRegression", k=5, parallelism=5)
    return _rounded(table)


def q_holdout(spark, sf_dir):
    """Hold-out of both arms (standard scaler + forest), 3-class."""
    table, _, _, _ = srch.holdout(_model_rows(spark, sf_dir))
    return _rounded(table)


def q_parity_search(spark, sf_dir):
    """Demographic-parity search on documents by language (fixture L,
    binary quality label), logistic base model; one row per grid point."""
    docs = fx.documents_labelled(spark, sf_dir)
    spec = mdl.ArmSpec(population_aware=True, model="LogisticRegression", group_col="grp",
                       label_col="y", numeric=("n_chars",), categorical=("grp",), sequence=())
    _, table = srch.parity_search(docs, spec)
    return _rounded(table)


def q_fit_boosted_3class(spark, sf_dir):
    """M2 + M7: three-class boosted trees (one soft-max model), per-population metrics."""
    tr, te = _split_features(spark, sf_dir)
    return _arm_groups(tr, te, mdl.ArmSpec(population_aware=True, model="Boosted"), [0, 1, 2])


def q_boosted_one_round(spark, sf_dir):
    """M2: the first round of three-class boosting with both penalties: each
    class's best root split (gain) and its two leaf weights."""
    spec = mdl.ArmSpec(population_aware=False, model="Boosted", numeric=("allele_count",), sequence=(),
                       categorical=("gene", "chromosome", "region"),
                       params={"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "regAlpha": 1, "regLambda": 10})
    fitted = mdl.fit_arm(_model_rows(spark, sf_dir), spec, [0, 1, 2])
    nodes = fitted.model.trees.table(spark)
    weight = lambda n: F.max(F.when(F.col("node") == n, F.col("value")[0]))
    return _rounded(nodes.groupBy(F.col("tree").cast("int").alias("cls")).agg(
        F.max("gain").alias("gain"), weight(2).alias("w_left"), weight(3).alias("w_right")))


def q_compare_arms(spark, sf_dir):
    """M9: population-aware and agnostic arms of the three families on one split."""
    tr, te = _split_features(spark, sf_dir)
    return _rounded(srch.compare_arms(tr, te, parallelism=3))


def q_group_threshold_fit(spark, sf_dir):
    """M6 + M7: per-group thresholds learned on a fitted forest, per-population metrics."""
    tr, te = _split_features(spark, sf_dir)
    return _arm_groups(tr, te, mdl.ArmSpec(population_aware=True, model="FairnessAware"), [0, 1, 2])


def q_holdout_by_population(spark, sf_dir):
    """A15 + M11: hold-out accuracy per population of both default arms."""
    return _rounded(srch.holdout(_model_rows(spark, sf_dir))[1])


def q_holdout_counts(spark, sf_dir):
    """A15 + M11: evaluated hold-out rows per default arm and population (checks what was scored, not the fit)."""
    return srch.holdout(_model_rows(spark, sf_dir))[1].select("arm", "pop", "n")


def q_saved_arm_difference(spark, sf_dir):
    """S7 + T8: a population-aware arm scores its test rows before saving and
    after loading (group means included); rows, and rows that differ."""
    tr, te = _split_features(spark, sf_dir)
    fitted = mdl.fit_arm(tr, mdl.ArmSpec(population_aware=True, model="LogisticRegression"), [0, 1, 2])
    path = _scratch(spark, "arm-")
    mdl.save_arm(fitted, path)
    before = fitted.transform(te).select(*te.columns, F.col("probs").alias("_before"))
    both = mdl.load_arm(path).transform(before)
    off = F.exists(F.zip_with("_before", "probs", lambda p, q: F.abs(p - q)), lambda d: d > 1e-12)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).alias("differing"))


def q_logistic_optimality(spark, sf_dir):
    """M3: the gradient of the stated objective (mean weighted log-loss plus
    half the squared norm over C x sum of weights) at the fitted binary
    solution, as an aggregate over the training rows: below 1e-3 in every slot."""
    from pyspark.ml.stat import Summarizer
    tr, _ = _split_features(spark, sf_dir, binary=True)
    spec = mdl.ArmSpec(population_aware=False, model="LogisticRegression")
    tr = mdl.arm_rows(tr, spec).persist()
    feats = mdl.fit_features(tr, spec)
    x = feats.matrix(tr).persist()
    fitted = mdl.fit_on(x, feats, spec, [0, 1])
    miss = F.when(F.col("label") == 1, 1 - F.element_at("probs", 2)).otherwise(F.element_at("probs", 2))
    scored = fitted.predict(x).withColumn("_r", miss * F.col("weight"))
    sums = {r["label"]: r["s"] for r in scored.groupBy("label").agg(
        Summarizer.sum(F.col("features"), F.col("_r")).alias("s")).collect()}
    total = x.agg(F.sum("weight")).first()[0]
    x.unpersist()
    tr.unpersist()
    b = fitted.model.coefficients.toArray()
    grad = (sums[0.0].toArray() - sums[1.0].toArray()) / total + b / total
    return spark.createDataFrame([(bool(abs(grad).max() < 1e-3),)], "optimal BOOLEAN")


def q_onehot_slot_sums(spark, sf_dir):
    """T3 + T5 + T6: rows per one-hot slot of the assembled feature vector, by slot name."""
    from pyspark.ml.stat import Summarizer
    from .operators import transform as tfm
    rows = _model_rows(spark, sf_dir)
    feats = mdl.fit_features(rows, mdl.ArmSpec(population_aware=False, model="LogisticRegression", scaler="none"))
    x = feats.matrix(rows)
    names = tfm.feature_names(x)
    total = x.agg(Summarizer.sum(F.col("features")).alias("s")).first()["s"].toArray()
    cells = [(n, float(v)) for n, v in zip(names, total) if n.startswith("cat_")]
    return spark.createDataFrame(cells, "name STRING, total DOUBLE")


QUERIES.update({
    "fit_boosted_3class": q_fit_boosted_3class,
    "boosted_one_round": q_boosted_one_round,
    "compare_arms": q_compare_arms,
    "group_threshold_fit": q_group_threshold_fit,
    "holdout_by_population": q_holdout_by_population,
    "holdout_counts": q_holdout_counts,
    "saved_arm_difference": q_saved_arm_difference,
    "logistic_optimality": q_logistic_optimality,
    "onehot_slot_sums": q_onehot_slot_sums,
    "fit_forest": q_fit_forest,
    "fit_boosted": q_fit_boosted,
    "fit_logistic": q_fit_logistic,
    "feature_importance": q_feature_importance,
    "score_saved_model": q_score_saved_model,
    "cv_grid": q_cv_grid,
    "random_search": q_random_search,
    "holdout": q_holdout,
    "parity_search": q_parity_search,
})


# ---------------------------------------------------------------- sinks, stage store, sets, contract
from .sources.readers import read_variants_csv, write_table  # noqa: E402
from .sources.stages import StageStore  # noqa: E402
from .streaming.scoring import publish_arm, score, score_available  # noqa: E402


def q_csv_roundtrip(spark, sf_dir):
    """S3: class distribution written as header CSV to the shared folder and read back."""
    path = _scratch(spark, "csv-") + "/class_distribution"
    write_table(q_class_distribution(spark, sf_dir), path, "csv")
    return spark.read.schema("mapped_target STRING, n BIGINT, share DOUBLE").option("header", True).csv(path)


# the columns of the three files of csv_scan, in their order; the last one has no region
CSV_LAYOUTS = (
    ("variant_id", "gene", "position", "population_name", "region", "allele", "allele_freq", "allele_count"),
    ("allele_count", "allele_freq", "allele", "region", "population_name", "position", "gene", "variant_id"),
    ("gene", "variant_id", "allele", "position", "allele_freq", "population_name", "allele_count"),
)


def q_csv_scan(spark, sf_dir):
    """S1 + S2: the variants written as CSV in three folders, each with its own
    column order, read back as one table by the files' headers."""
    path = _scratch(spark, "csv-")
    rows = fx.variants(spark, sf_dir)
    part = F.pmod(F.col("position"), F.lit(3))
    for i, cols in enumerate(CSV_LAYOUTS):
        write_table(rows.where(part == i).select(*cols), f"{path}/part{i}", "csv")
    return read_variants_csv(spark, f"{path}/*").select(*CSV_LAYOUTS[0])


def q_stream_score(spark, sf_dir):
    """S8 + R3: hold-out rows with rule codes arrive as files in two lots; a
    run over what is available follows each (the second one continues from
    the first one's checkpoint). Rule scores of every row, and whether the
    stream's scores are those of scoring the table at once."""
    tr, te = _split_features(spark, sf_dir)
    fitted = mdl.fit_arm(tr, mdl.ArmSpec(population_aware=True, model="LogisticRegression"), [0, 1, 2])
    store = StageStore(spark, _scratch(spark, "arms-"))
    publish_arm(store, "scorer", fitted)
    codes = fx.rule_codes(spark, sf_dir).groupBy(F.col("h").alias("variant_id")).agg(F.collect_list("code").alias("codes"))
    rows = te.join(codes, "variant_id", "left")
    base = _scratch(spark, "stream-")
    for lot in range(2):
        rows.where(F.pmod(F.xxhash64("variant_id"), F.lit(2)) == lot).write.parquet(f"{base}/in/lot{lot}")
        out = score_available(store, "scorer", f"{base}/in/*", rows.schema, f"{base}/out", f"{base}/checkpoint",
                              files_per_batch=4, factors=FIXTURE_FACTORS)
    at_once = score(fitted, rows, factors=FIXTURE_FACTORS).select(
        "variant_id", F.col("hybrid_score").alias("_hybrid"), F.col("yhat").alias("_yhat"))
    same = (F.abs(F.col("hybrid_score") - F.col("_hybrid")) < 1e-12) & (F.col("yhat") == F.col("_yhat"))
    return _rounded(out.join(at_once, "variant_id", "left").select(
        "variant_id", "acmg_raw", "acmg_norm", F.coalesce(same, F.lit(False)).alias("same")))


def q_stage_roundtrip(spark, sf_dir):
    """S4 + S5: per-group metrics saved as a stage, then the latest entry
    for (stage, mode, fingerprint) loaded back through the manifest."""
    store = StageStore(spark, _scratch(spark, "stages-"))
    store.save("group_metrics", q_group_metrics(spark, sf_dir), "three_class", "fp")
    return store.load("group_metrics", "three_class", "fp")


def q_sorted_sets(spark, sf_dir):
    """A4 + K5: sorted distinct populations, classes and (data-present) pathways."""
    df = _labelled(spark, sf_dir)
    gp = F.create_map(*[x for g, ps in FIXTURE_PATHWAYS.items()
                        for x in (F.lit(g), F.array(*[F.lit(p) for p in ps]))])
    paths = F.explode(F.coalesce(F.try_element_at(gp, F.col("gene")), F.array().cast("array<string>")))
    return (df.select("population_name", "mapped_target", paths.alias("pathway"))
            .agg(F.array_sort(F.collect_set("population_name")).alias("populations"),
                 F.array_sort(F.collect_set("mapped_target")).alias("classes"),
                 F.array_sort(F.collect_set("pathway")).alias("pathways"),
                 F.countDistinct("population_name").alias("n_populations")))


def q_split_contract(spark, sf_dir):
    """Train ∪ test = input, train ∩ test = ∅ (counts of violations)."""
    df = _labelled(spark, sf_dir).select("variant_id", "population_name", "target_encoded")
    c = spl.split_contract(df, spl.stratified_split(df, seed=42))
    return spark.createDataFrame([(c["missing"], c["extra"], c["overlap"])],
                                 "missing BIGINT, extra BIGINT, overlap BIGINT")


QUERIES.update({
    "csv_roundtrip": q_csv_roundtrip,
    "csv_scan": q_csv_scan,
    "stream_score": q_stream_score,
    "stage_roundtrip": q_stage_roundtrip,
    "sorted_sets": q_sorted_sets,
    "split_contract": q_split_contract,
})

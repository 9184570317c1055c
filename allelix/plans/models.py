"""Models and one-arm fitting.

Estimators are ``pyspark.ml`` classifiers (M3) or the histogram trees of
``trees.py`` (M1, M2); the feature pipeline is built from the column roles of the arm's frame (P8) and fitted on training rows only.

M1 forest    ``trees.HistogramForest``, 100 trees, depth 10, balanced weights
M2 boosted   ``trees.HistogramBoosted``: second-order boosting, soft-max over
             all classes in one model, L1 / L2 leaf penalties; 100 rounds, depth 5,
             rate 0.1, no class weights
M3 logistic  LogisticRegression (binomial for two classes, else multinomial), 1000 iterations, balanced
             weights, L2 with regParam = 1 / (C * sum of weights) so the
             objective matches "C x weighted log-loss + half squared norm"
M6 group thresholds: base forest + per-group thresholds (W2, W3) learned on
             training rows; prediction = K2.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import metrics as met
from ..operators import split as spl
from ..operators import thresholds as thr
from ..operators import transform as tf
from ..operators.joins import bounded_rows
from ..operators.text import CharCounts
from .trees import BoostedModel, ForestModel, HistogramBoosted, HistogramForest

# --- fixed values: model defaults (as in the reference) ----------------------
FOREST_DEFAULTS = {"numTrees": 100, "maxDepth": 10}
BOOSTED_DEFAULTS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}
LOGISTIC_DEFAULTS = {"maxIter": 1000, "C": 1.0, "penalty": "l2"}
# rows that one task of an iterative fit reads: every iteration sends a result per task to the driver
FIT_TASK_ROWS = 250_000
# a pass over fewer rows takes less than the job around it
FEW_ROWS = 50_000
MODEL_NAMES = ("RandomForest", "Boosted", "LogisticRegression", "FairnessAware")
# ---------------------------------------------------------------------------

LABEL, WEIGHT, FEATURES = "label", "weight", "features"
# more partitions than any table has: coalescing to them moves no row
OWN_STAGE = 1_000_000


def make_estimator(name: str, classes, total_weight: float | None = None, seed: int = 42, **params):
    """M5: estimator factory by name; unknown names are an error."""
    if name == "RandomForest":
        return HistogramForest(classes, FEATURES, LABEL, WEIGHT, seed, **{**FOREST_DEFAULTS, **params})
    if name == "Boosted":
        return HistogramBoosted(classes, FEATURES, LABEL, None, seed, **{**BOOSTED_DEFAULTS, **params})
    if name == "LogisticRegression":
        p = {**LOGISTIC_DEFAULTS, **params}
        C, penalty = float(p.pop("C")), p.pop("penalty")
        p.pop("solver", None)  # no counterpart
        reg = 1.0 / (C * (total_weight or 1.0))
        # two classes have one coefficient row; two mirrored rows would halve the penalty
        return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT,
                                  family="binomial" if len(classes) <= 2 else "multinomial", standardization=False, regParam=reg,
                                  elasticNetParam=1.0 if penalty == "l1" else 0.0, **p)
    if name == "FairnessAware":
        return GroupThresholdClassifier(classes, seed=seed, **params)
    raise ValueError(f"Unknown model: {name}")


@dataclass
class ArmSpec:
    population_aware: bool = True
    scaler: str = "standard"
    model: str = "RandomForest"
    params: dict = field(default_factory=dict)
    include_sequence: bool = True
    include_pathways: bool = False
    drop_categoricals: tuple = ()
    group_col: str = "population_name"
    label_col: str = "target_encoded"
    # explicit feature lists override the variant column roles (P8), so any
    # table with a group and a label column can be modelled
    numeric: tuple | None = None
    categorical: tuple | None = None
    sequence: tuple | None = None
    # categorical encoding: None = "index" for tree models, "onehot" otherwise
    encoding: str | None = None

    def cat_encoding(self) -> str:
        if self.encoding:
            return self.encoding
        return "onehot" if self.model == "LogisticRegression" else "index"


def prepare_arm(df: DataFrame, spec: ArmSpec) -> DataFrame:
    """P9 + P10: the agnostic arm drops the group and prefixed columns."""
    out = df if spec.population_aware else feat.arm_projection(df, spec.group_col)
    return out


def feature_stages(train: DataFrame, spec: ArmSpec):
    """Fit-on-train feature stages for the arm (T1-T5) and the block names."""
    num, cat, seq = feat.column_roles(train.columns, spec.population_aware)
    if spec.numeric is not None:
        num = [c for c in spec.numeric if c in train.columns]
    if spec.categorical is not None:
        cat = [c for c in spec.categorical if c in train.columns]
    if spec.sequence is not None:
        seq = [c for c in spec.sequence if c in train.columns]
    if spec.include_pathways:
        num += [c for c in train.columns if c.startswith("pathway_")]
    cat = [c for c in cat if c not in spec.drop_categoricals]
    if spec.model == "LogisticRegression" or spec.cat_encoding() != "index":
        stages = tf.fit_numeric(train, num, spec.scaler)
    else:
        # trees see each numeric column as at most TREE_BINS quantile bins
        stages = tf.fit_numeric(train, num, spec.scaler, prefix="_sc_")
        stages += tf.numeric_bins(train, stages, num)
    stages += tf.categorical_stages(cat, encoding=spec.cat_encoding())
    blocks = [f"num_{c}" for c in num] + [f"cat_{c}" for c in cat]
    if spec.include_sequence and seq:
        cc = CharCounts(columns=tuple(seq)).fit(train)
        if cc.vocabulary:
            stages.append(tf.char_count_stage(cc.vocabulary, cc.columns))
            blocks += [f"seq_{i}" for i in range(len(cc.vocabulary))]
    stages.append(tf.assembler(blocks))
    return stages


def with_label_weight(df: DataFrame, label_col: str) -> DataFrame:
    out = df.withColumn(LABEL, F.col(label_col).cast("double"))
    return spl.balanced_weights(out, LABEL, WEIGHT)


@dataclass
class ArmFeatures:
    """The fitted features of an arm: group means (T8) learned on the training
    rows, then the pipeline. They depend on (scaler, fold), not on the model's
    parameters, so a search fits them once and every model reads one matrix."""

    spec: ArmSpec
    pipeline: PipelineModel
    means: feat.GroupMeans | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Raw or prepared rows with the feature vector; other columns stay."""
        g = self.spec.group_col
        if self.means is not None and self.means.ratio_col not in df.columns:
            df = self.means.transform(feat.interaction_terms(df, g))
        # the agnostic arm never sees the group as a feature, but evaluation
        # still needs it: carry it under a name no feature role uses
        keep = g in df.columns and not self.spec.population_aware
        src = df.withColumn("__eval_group", F.col(g)) if keep else df
        # a code stage of their own for the pipeline's expressions: in one method with the rows'
        # derivations and joins, Java would interpret them (it compiles methods of up to 8,000 bytes only)
        x = self.pipeline.transform(prepare_arm(src, self.spec).coalesce(OWN_STAGE))
        return x.withColumnRenamed("__eval_group", g) if keep else x

    def matrix(self, df: DataFrame, *more: str) -> DataFrame:
        """(label, weight, features, group) of labelled rows, to be persisted by the caller."""
        rows = with_label_weight(df, self.spec.label_col)
        g = [self.spec.group_col] if self.spec.group_col in df.columns else []
        return self.transform(rows).select(LABEL, WEIGHT, FEATURES, *g, *more)


def arm_rows(train: DataFrame, spec: ArmSpec) -> DataFrame:
    """The columns that fitting an arm reads. Every statistic, the class weights and the matrix are a pass
    over them, so the caller persists them: their derivations and the split then aren't done again in each."""
    num, cat, seq = feat.column_roles(train.columns)
    used = {*num, *cat, *seq, *(spec.numeric or ()), *(spec.categorical or ()), *(spec.sequence or ()),
            *feat.POP_CATEGORICAL, feat.GroupMeans.ratio_col, spec.group_col, spec.label_col}
    return train.select(*[c for c in train.columns if c in used or c.startswith("pathway_")])


def kept_evenly(rows: DataFrame) -> DataFrame:
    """The rows, persisted. Every pass of a fit waits for the task with the most rows, so where that one has far
    more than a core's share (a file of few row groups) they are spread over tasks of one size first."""
    kept = rows.persist()
    pieces = kept.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    n, largest = pieces.agg(F.sum("_n"), F.max("_n")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not n or largest <= FEW_ROWS or largest * cores <= 1.5 * n:
        return kept
    spread = kept.repartition(max(cores, -(-n // FIT_TASK_ROWS))).persist()
    spread.count()
    kept.unpersist()
    return spread


def fit_features(train: DataFrame, spec: ArmSpec) -> ArmFeatures:
    """Learn group means and the feature pipeline on training rows."""
    means, df = None, train
    aware = spec.population_aware and spec.numeric is None
    if aware and spec.group_col in train.columns and "allele_freq" in train.columns:
        means = feat.GroupMeans(group_col=spec.group_col)
        if means.ratio_col in train.columns:
            means = None  # the caller's rows already carry it
        else:
            df = means.fit(train).transform(feat.interaction_terms(train, spec.group_col))
    arm = prepare_arm(df, spec)
    return ArmFeatures(spec, Pipeline(stages=feature_stages(arm, spec)).fit(arm), means)


@dataclass
class ArmModel:
    spec: ArmSpec
    features: ArmFeatures
    model: object
    classes: list

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict(self.features.transform(df))

    def predict(self, x: DataFrame) -> DataFrame:
        """Scores of rows that already have the feature vector."""
        out = self.model.transform(x)
        if "probs" not in out.columns and "probability" in out.columns:
            out = out.withColumn("probs", vector_to_array("probability"))
        return out.withColumn("yhat", F.col("prediction").cast("int"))


def fit_arm(train: DataFrame, spec: ArmSpec, classes, seed: int = 42) -> ArmModel:
    """Fit the arm's features and classifier on training rows."""
    # trees pack their rows into blocks of one size, and their draws go by block
    rows = arm_rows(train, spec)
    rows = kept_evenly(rows) if spec.model == "LogisticRegression" else rows.persist()
    feats = fit_features(rows, spec)
    x = feats.matrix(rows).persist()
    model = fit_on(x, feats, spec, classes, seed)
    x.unpersist()
    rows.unpersist()
    return model


def fit_on(x: DataFrame, feats: ArmFeatures, spec: ArmSpec, classes, seed: int = 42, weighted: bool = False) -> ArmModel:
    """Fit the arm's classifier on a persisted matrix (label, weight, features, group).

    Boosted trees take no class weights; ``weighted`` says that the weights are the caller's own."""
    total_w = x.agg(F.sum(WEIGHT)).first()[0]
    est = make_estimator(spec.model, classes, total_w, seed, **spec.params)
    if isinstance(est, HistogramBoosted) and weighted:
        est.weight = WEIGHT
    if isinstance(est, GroupThresholdClassifier):
        aware = spec.population_aware and spec.group_col in x.columns
        est.group_col = spec.group_col if aware else None
    return ArmModel(spec, feats, est.fit(x), list(classes))


def evaluate_arm(model: ArmModel, test: DataFrame, group_col: str = "population_name",
                 label_col: str = "target_encoded") -> dict[str, DataFrame]:
    """M7: overall metrics, per-group metrics and the accuracy gap."""
    return evaluate_scored(model.transform(test), group_col, label_col)


def evaluate_scored(out: DataFrame, group_col: str = "population_name", label_col: str = LABEL) -> dict[str, DataFrame]:
    """M7 for rows with a prediction ``yhat``."""
    scored = out.select(F.col(label_col).cast("int").alias("y"), "yhat",
                        F.coalesce(F.col(group_col).cast("string"), F.lit("nan")).alias("grp")
                        if group_col in out.columns else F.lit("all").alias("grp"))
    cube = met.confusion_cube(scored, "y", "yhat", "grp")
    overall = met.summary(cube.groupBy("y", "yhat").agg(F.sum("n").alias("n")))
    groups = met.summary(cube, "grp")
    gap = met.accuracy_gap(groups.select("grp", "accuracy"))
    return {"overall": overall, "groups": groups, "gap": gap, "cube": cube}


class GroupThresholdClassifier:
    """M6: base forest, then per-group, per-class thresholds learned on the
    training rows (ROC point nearest the target FPR); predict = K2."""

    def __init__(self, classes, seed: int = 42, target_fpr: float = 0.1, **params):
        self.classes = list(classes)
        self.seed = seed
        self.target_fpr = target_fpr
        self.params = params
        self.group_col: str | None = "population_name"

    def fit(self, x: DataFrame) -> "GroupThresholdModel":
        base = HistogramForest(self.classes, FEATURES, LABEL, WEIGHT, self.seed, **{**FOREST_DEFAULTS, **self.params}).fit(x)
        scored = base.transform(x)
        g = self.group_col
        scored = scored.withColumn("_grp", F.col(g) if g else F.lit("all"))
        sc = thr.class_scores(scored, "_grp", LABEL, "probs", self.classes)
        vectors = thr.threshold_vectors(thr.group_thresholds(sc, self.classes, self.target_fpr),
                                        len(self.classes))
        rows = bounded_rows(vectors, 1_000_000, "group threshold table")  # groups x k numbers
        local = [(r["grp"], list(r["thr"])) for r in rows]
        return GroupThresholdModel(base, self.classes, local, g)


class GroupThresholdModel:
    def __init__(self, base, classes, vectors, group_col):
        self.base, self.classes, self.vectors, self.group_col = base, classes, vectors, group_col

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        vec = spark.createDataFrame(self.vectors, "grp STRING, thr ARRAY<DOUBLE>")
        out = self.base.transform(df)
        out = out.withColumn("_grp", F.col(self.group_col) if self.group_col and self.group_col in df.columns
                             else F.lit("all"))
        out = thr.predict_with_thresholds(out, vec, "_grp", "probs", len(self.classes), out_col="_k",
                                          classes=self.classes)
        return out.withColumn("prediction", F.col("_k").cast("double")).drop("_k", "_grp")


def feature_importance(model: ArmModel, scored_sample: DataFrame, top_n: int = 20) -> DataFrame:
    """K1 + J6: (rank, idx, name, importance) of the top-n features, names
    from the features column's metadata; empty on a length mismatch."""
    spark = scored_sample.sparkSession
    m = model.model
    imp = getattr(m, "featureImportances", None)
    if imp is None:
        return spark.createDataFrame([], "rank INT, idx INT, name STRING, importance DOUBLE")
    names = tf.feature_names(model.features.transform(scored_sample))
    values = imp.toArray().tolist()
    if len(names) != len(values) or not names:
        return spark.createDataFrame([], "rank INT, idx INT, name STRING, importance DOUBLE")
    table = spark.createDataFrame([(i, names[i], float(v)) for i, v in enumerate(values)],
                                  "idx INT, name STRING, importance DOUBLE")
    return (table.orderBy(F.desc("importance"), "idx").limit(top_n)
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "idx")))
            .select("rank", "idx", "name", "importance"))


def save_arm(model: ArmModel, path: str) -> None:
    """Group means, features pipeline + classifier under ``path``."""
    model.features.pipeline.write().overwrite().save(f"{path}/features")
    if model.features.means is not None:
        model.features.means.save(f"{path}/group_means")
    if isinstance(model.model, (BoostedModel, ForestModel)):
        model.model.save(f"{path}/model")
        kind = model.model.kind
    elif isinstance(model.model, GroupThresholdModel):
        model.model.base.save(f"{path}/model")
        kind = "group_threshold"
    else:
        model.model.write().overwrite().save(f"{path}/model")
        kind = type(model.model).__name__
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = {"kind": kind, "classes": model.classes, "spec": model.spec.__dict__,
            "vectors": getattr(model.model, "vectors", None),
            "group_means": model.features.means is not None}
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").write.mode("overwrite").json(f"{path}/meta")


def load_arm(path: str) -> ArmModel:
    """Load what ``save_arm`` wrote."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    sp = dict(meta["spec"])
    for key in ("drop_categoricals", "numeric", "categorical", "sequence"):
        if sp.get(key) is not None:
            sp[key] = tuple(sp[key])
    spec = ArmSpec(**sp)
    means = None
    if meta.get("group_means"):
        means = feat.GroupMeans(group_col=spec.group_col).load(spark, f"{path}/group_means")
    feats = ArmFeatures(spec, PipelineModel.load(f"{path}/features"), means)
    kind = meta["kind"]
    if kind == "group_threshold":
        base = ForestModel.load(f"{path}/model")
        model = GroupThresholdModel(base, meta["classes"], [tuple(v) for v in meta["vectors"]],
                                    spec.group_col)
    else:
        loaders = {"forest": ForestModel, "boosted": BoostedModel, "LogisticRegressionModel": LogisticRegressionModel}
        model = loaders[kind].load(f"{path}/model")
    return ArmModel(spec, feats, model, meta["classes"])


"""Stage driver (M14): EDA -> CV -> arm comparison -> tuning -> hold-out ->
export, each stage resumable from the stage store (S4-S7).

``run(spark, variants, config)`` takes the raw variant table (any source:
``sources.readers``), so the same code runs on a laptop or a cluster. Stage
outputs are tables; a second run with the same input and configuration
reads them back and computes nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import labels as lab
from ..operators import profile as prof
from ..operators import split as spl
from ..sources.stages import StageStore, fingerprint
from . import models as M
from . import search as S


@dataclass
class RunConfig:
    base: str
    binary: bool = False
    stages: tuple = ("eda", "cv", "comparison", "tuning", "holdout", "export")
    scalers: tuple = S.SCALERS
    cv_models: tuple = S.CV_MODELS
    compare_models: tuple = ("RandomForest", "Boosted", "LogisticRegression")
    tune_models: tuple = ("RandomForest", "Boosted", "LogisticRegression")
    n_draws: int = S.N_DRAWS
    k: int = 5
    seed: int = 42
    parallelism: int = 1
    group_means_on: str = "train"  # each arm's training rows, or "all" rows for parity with the reference
    model_params: dict = field(default_factory=dict)


def featurise(variants: DataFrame, binary: bool, means_on: str = "train") -> DataFrame:
    """Labels (P1-P4), sequence (P5) and interaction features.

    With ``means_on="train"`` the group means (T8) are left to each arm, which
    learns them on its own training rows and keeps them; ``"all"`` adds means
    of every row, test rows included."""
    df = feat.sequence_features(lab.prepare_target(variants, binary=binary))
    return feat.population_features(df) if means_on == "all" else feat.interaction_terms(df)


def run(spark: SparkSession, variants: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    store = StageStore(spark, config.base)
    mode = "binary" if config.binary else "three_class"
    fp = fingerprint(variants, asdict(config) | {"base": None})
    df = featurise(variants, config.binary, config.group_means_on).persist()
    out: dict[str, DataFrame] = {}
    reused: dict[str, bool] = {}

    def stage(name, compute, gate=None):
        if (gate or name) not in config.stages:
            return None
        frame, hit = store.get_or_compute(name, compute, mode, fp)
        out[name], reused[name] = frame, hit
        return frame

    stage("eda", lambda: lab.class_distribution(df))
    stage("eda_histogram", lambda: prof.histogram(df, "allele_freq"), gate="eda")
    stage("cv", lambda: S.cv_summary(S.cv_grid(
        df, scalers=config.scalers, models=config.cv_models, k=config.k, seed=config.seed,
        parallelism=config.parallelism, params=config.model_params)))
    split_df = None
    if {"comparison", "tuning", "holdout", "export"} & set(config.stages):
        # one stored split for every later stage
        split_df = stage("split", lambda: spl.stratified_split(df, seed=config.seed),
                         gate=next(s for s in ("comparison", "tuning", "holdout", "export") if s in config.stages))
        train, test = spl.train_test(split_df)
    if "comparison" in config.stages:
        stage("comparison", lambda: S.compare_arms(train, test, models=config.compare_models,
                                                    seed=config.seed, parallelism=config.parallelism))
    tuned: dict[str, dict] = {}
    if "tuning" in config.stages:
        for m in config.tune_models:
            table = stage(f"tuning_{m}", lambda m=m: S.random_search(
                train, m, n_draws=config.n_draws, k=config.k, seed=config.seed,
                parallelism=config.parallelism)[0], gate="tuning")
            best = S.best_params(table).first()
            tuned[m] = {"params": next(p for p in S.sample_grid(S.PARAM_GRIDS[m], config.n_draws, config.seed)
                                       if S._ptext(p) == best["params"]), "score": best["mean_score"]}
    if "holdout" in config.stages or "export" in config.stages:
        _holdout(spark, df, split_df, config, mode, fp, store, tuned, out, reused)
    df.unpersist()
    out["_reused"] = spark.createDataFrame([(k, v) for k, v in reused.items()], "stage STRING, reused BOOLEAN")
    return out


def _holdout(spark, df, split_df, config, mode, fp, store, tuned, out, reused) -> None:
    """Hold-out of both arms of the best tuned family (a forest without tuning):
    its tables become stages, and the evaluated arms themselves are saved."""
    names = ("holdout", "holdout_populations", "holdout_confusion", "export")
    found = {n: store.load(n, mode, fp) for n in names}
    hit = all(v is not None for v in found.values())
    if not hit:
        family = max(tuned, key=lambda m: tuned[m]["score"]) if tuned else "RandomForest"
        params = tuned[family]["params"] if tuned else {}
        arm = {"scaler": "standard", "model": family, "params": params}
        table, pops, cm, arms = S.holdout(df, best={"population_aware": arm, "nonpopulation_aware": arm},
                                          seed=config.seed, split_df=split_df)
        top = S.best_model(table).first()["arm"]
        rows = []
        for name, fitted in arms.items():
            path = f"{config.base}/models/{name}_{mode}_{fp}"
            M.save_arm(fitted, path)
            rows.append((name, fitted.spec.model, path, name == top))
        export = spark.createDataFrame(rows, "arm STRING, model STRING, path STRING, best BOOLEAN")
        for n, frame in zip(names, (table, pops, cm, export)):
            store.save(n, frame, mode, fp)
            found[n] = store.load(n, mode, fp)
    shown = names if "export" in config.stages else names[:3]
    out.update({n: found[n] for n in shown})
    reused.update({n: hit for n in shown})


def exported_path(out: dict[str, DataFrame]) -> str:
    """The path of the best exported arm."""
    return out["export"].where("best").select(F.col("path")).first()[0]

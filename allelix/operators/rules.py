"""Rule (ACMG criteria) scores over tables.

Two input shapes:
  long form  (key, population, code) rows -> ``score_long``: weight and
             factor lookups are map literals (known-size parameters), then
             ``sum`` and ``product`` per key — partial aggregation, so a key
             with very many codes never forms one array or one hot task.
  array form a codes ARRAY column per row -> ``functions.rules.rule_score``
             (stateless; also usable on a stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import blend, factor_map, normalise_score, weight_map


def score_long(codes: DataFrame, key: str = "h", population: str = "pop", code: str = "code",
               weights: dict | None = None, factors: dict | None = None,
               score_col: str = "acmg_score") -> DataFrame:
    """R1 + A19: score = (sum of code weights) x (product of the matching
    population factors), one row per (key, population)."""
    wm, fm = weight_map(weights), factor_map(factors)
    pop_f = F.try_element_at(fm, F.coalesce(F.col(population), F.lit("\u0000")))
    w = F.coalesce(F.try_element_at(wm, F.col(code)), F.lit(0.0))
    f = F.coalesce(F.try_element_at(pop_f, F.col(code)), F.lit(1.0))
    return (codes.select(key, population, w.alias("_w"), f.alias("_f"))
            .groupBy(key, population)
            .agg((F.sum("_w") * F.product("_f")).alias(score_col)))


def attach_scores(rows: DataFrame, scores: DataFrame, key: str = "h", population: str = "pop",
                  score_col: str = "acmg_score") -> DataFrame:
    """Each row gets the score of its own (key, population), 0 without any
    code. ``scores`` has one row per (key, population), so no row multiplies;
    NULL keys or populations match each other."""
    s = scores.select(F.col(key).alias("_sk"), F.col(population).alias("_sp"), F.col(score_col).alias("_ss"))
    own = F.col(key).eqNullSafe(F.col("_sk")) & F.col(population).eqNullSafe(F.col("_sp"))
    return (rows.join(s, own, "left")
            .withColumn(score_col, F.coalesce(F.col("_ss"), F.lit(0.0))).drop("_sk", "_sp", "_ss"))


def blend_scores(df: DataFrame, prob_col: str, score_col: str = "acmg_score",
                 alpha: float = 0.7, lo: float = -20.0, hi: float = 20.0) -> DataFrame:
    """R2: alpha * p + (1 - alpha) * (score - lo) / (hi - lo), not clipped."""
    return df.withColumn("blend", blend(F.col(prob_col), F.col(score_col), alpha, lo, hi, clip=False))


def hybrid_scores(df: DataFrame, prob_col: str, score_col: str = "acmg_score",
                  alpha: float = 0.7, lo: float = -20.0, hi: float = 20.0) -> DataFrame:
    """Probability, raw score, normalised score clipped to [0, 1], hybrid."""
    norm = normalise_score(F.col(score_col), lo, hi, clip=True)
    return df.select("*", F.col(prob_col).alias("prob_pathogenic"),
                     F.col(score_col).alias("acmg_raw"), norm.alias("acmg_norm"),
                     (F.lit(alpha) * F.col(prob_col) + F.lit(1 - alpha) * norm).alias("hybrid_score"))

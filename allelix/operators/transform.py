"""Feature transformers fitted on training rows.

Each ``fit_*`` learns its statistics with one or two aggregations and
returns *built-in* Spark ML stages (``SQLTransformer`` with the learned
constants as literals, ``Bucketizer``, ``StringIndexer``, ``OneHotEncoder``,
``VectorAssembler``), so a fitted pipeline is a plain ``PipelineModel`` that
saves, loads and scores batches or streams without custom code.

Numeric strategies (``scaler``):
  none      mean imputation only (T1, T2d)
  standard  (x - mean) / population std; std 0 -> 1 (T2a)
  robust    (x - median) / (q75 - q25); IQR 0 -> 1, linear interpolation (T2b)
  quantile  interpolated rank through <= 1000 quantiles, then the inverse
            normal CDF, clipped (T2c)
All statistics after mean imputation, as a fit-on-train preprocessor does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.feature import (Bucketizer, OneHotEncoder, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf_sql
from .quantiles import exact_quantiles

# --- fixed values (library conventions the reference relies on) -------------
N_QUANTILES = 1000
BOUNDS_THRESHOLD = 1e-7
CLIP_LO = -5.199337582605575   # inverse normal CDF of (1e-7 - machine epsilon)
CLIP_HI = 5.19933758270342     # inverse normal CDF of 1 - (1e-7 - machine epsilon)
MISSING = "missing"
# ---------------------------------------------------------------------------

TREE_BINS = 255  # candidate splits of a numeric feature of a tree model (the usual histogram size)


def _q(c: str) -> str:
    return f"`{c}`"


def _lit(v: float) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "CAST(NULL AS DOUBLE)"
    return f"CAST({float(v)!r} AS DOUBLE)"


def _value(c: str) -> str:
    """The column as DOUBLE; NaN counts as missing."""
    return f"nullif(CAST({_q(c)} AS DOUBLE), double('NaN'))"


def fit_means(df: DataFrame, cols: Sequence[str]) -> tuple[dict, int]:
    """One pass: means of the known values and the row count."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.avg(F.expr(_value(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}, row["_n"]


def column_quantiles(df: DataFrame, exprs: dict[str, str], probs: Sequence[float], method: str = "exact",
                     accuracy: int = 1_000_000) -> dict:
    """Quantiles per column. ``exact``: distributed rank selection, one path for
    every size (``quantiles.exact_quantiles``). ``approx``: ``percentile_approx``."""
    probs = [float(p) for p in probs]
    if method == "approx":
        arr = "array(" + ", ".join(repr(p) for p in probs) + ")"
        row = df.agg(*[F.expr(f"percentile_approx({e}, {arr}, {accuracy})").alias(f"q{i}")
                       for i, e in enumerate(exprs.values())]).first()
        return {c: row[f"q{i}"] for i, c in enumerate(exprs)}
    return exact_quantiles(df, {c: F.expr(e) for c, e in exprs.items()}, probs)


def imputed(c: str, mean) -> str:
    # a column with no values imputes 0 (no statistic to learn)
    return f"coalesce({_value(c)}, {_lit(0.0 if mean is None else mean)})"


def fit_numeric(df: DataFrame, cols: Sequence[str], scaler: str = "standard",
                prefix: str = "num_", quantiles: str = "exact",
                accuracy: int = 1_000_000) -> list[Transformer]:
    """Fit T1 + T2 on ``df``; returns stages adding ``prefix + col`` columns.
    ``quantiles`` is ``exact`` (default) or ``approx`` for robust/quantile."""
    cols = list(cols)
    if not cols:
        return []
    means, n = fit_means(df, cols)
    imp = {c: imputed(c, means[c]) for c in cols}
    if scaler == "none":
        exprs = {c: imp[c] for c in cols}
    elif scaler == "standard":
        # one more pass for the population std of the imputed values
        row = df.agg(*[F.stddev_pop(F.expr(imp[c])).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        exprs = {}
        for i, c in enumerate(cols):
            sd = row[f"s{i}"]
            sd = 1.0 if (sd is None or sd == 0 or math.isnan(sd)) else sd
            mu = 0.0 if means[c] is None else means[c]
            exprs[c] = f"({imp[c]} - {_lit(mu)}) / {_lit(sd)}"
    elif scaler == "robust":
        qs = column_quantiles(df, imp, [0.25, 0.5, 0.75], quantiles, accuracy)
        exprs = {}
        for c in cols:
            q25, q50, q75 = qs[c] or (0.0, 0.0, 0.0)
            iqr = q75 - q25
            iqr = 1.0 if iqr == 0 else iqr
            exprs[c] = f"({imp[c]} - {_lit(q50)}) / {_lit(iqr)}"
    elif scaler == "quantile":
        return _fit_quantile(df, cols, imp, n, prefix, quantiles, accuracy)
    else:
        raise ValueError(f"unknown scaler {scaler!r}")
    stmt = "SELECT *, " + ", ".join(f"{e} AS {_q(prefix + c)}" for c, e in exprs.items()) + " FROM __THIS__"
    return [SQLTransformer(statement=stmt)]


def quantile_knots(quantiles: Sequence[float]) -> tuple[list, list, list]:
    """Distinct knots with the first and last reference each one covers."""
    m = len(quantiles)
    refs = [i / (m - 1) for i in range(m)] if m > 1 else [0.0]
    q = list(quantiles)
    for i in range(1, m):  # monotone fix of floating noise
        q[i] = max(q[i], q[i - 1])
    knots, r_lo, r_hi = [], [], []
    for v, r in zip(q, refs):
        if knots and v == knots[-1]:
            r_hi[-1] = r
        else:
            knots.append(v)
            r_lo.append(r)
            r_hi.append(r)
    return knots, r_lo, r_hi


def _fit_quantile(df, cols, imp, n, prefix, quantiles, accuracy) -> list[Transformer]:
    m = max(1, min(N_QUANTILES, n))
    refs = [i / (m - 1) for i in range(m)] if m > 1 else [0.0]
    qs = column_quantiles(df, imp, refs, quantiles, accuracy)
    stages: list[Transformer] = []
    pre = "SELECT *, " + ", ".join(f"{imp[c]} AS {_q('_imp_' + c)}" for c in cols) + " FROM __THIS__"
    stages.append(SQLTransformer(statement=pre))
    outs = []
    for i, c in enumerate(cols):
        knots, r_lo, r_hi = quantile_knots(qs[c] or [0.0])
        splits = [-math.inf] + knots + [math.inf]
        stages.append(Bucketizer(splits=splits, inputCol=f"_imp_{c}", outputCol=f"_bkt_{c}",
                                 handleInvalid="keep"))
        outs.append((c, knots, r_lo, r_hi))
    final = []
    for c, knots, r_lo, r_hi in outs:
        x, b = _q(f"_imp_{c}"), f"CAST({_q('_bkt_' + c)} AS INT)"
        ka = "array(" + ", ".join(_lit(k) for k in knots) + ")"
        la = "array(" + ", ".join(_lit(r) for r in r_lo) + ")"
        ha = "array(" + ", ".join(_lit(r) for r in r_hi) + ")"
        lo_k, hi_k = f"element_at({ka}, {b})", f"element_at({ka}, {b} + 1)"
        at_knot = f"(element_at({la}, {b}) + element_at({ha}, {b})) / 2"
        between = (f"element_at({ha}, {b}) + (element_at({la}, {b} + 1) - element_at({ha}, {b})) * "
                   f"({x} - {lo_k}) / ({hi_k} - {lo_k})")
        nk = len(knots)
        rank = (f"CASE WHEN {x} - {BOUNDS_THRESHOLD!r} < {_lit(knots[0])} THEN 0.0D "
                f"WHEN {x} + {BOUNDS_THRESHOLD!r} > {_lit(knots[-1])} THEN 1.0D "
                f"WHEN {b} = 0 THEN 0.0D WHEN {b} >= {nk} THEN 1.0D "
                f"WHEN {x} = {lo_k} THEN {at_knot} ELSE {between} END")
        final.append((c, rank))
    rank_stmt = ("SELECT *, " + ", ".join(f"{r} AS {_q('_rank_' + c)}" for c, r in final) + " FROM __THIS__")
    stages.append(SQLTransformer(statement=rank_stmt))
    stages.append(quantile_normal_stage(cols, prefix))
    return stages


def quantile_normal_stage(cols, prefix) -> SQLTransformer:
    """Final T2c step: inverse normal CDF of the rank, clipped, as SQL."""
    parts = []
    for c in cols:
        z = norm_ppf_sql(_q(f"_rank_{c}"))
        parts.append(f"least(greatest({z}, {_lit(CLIP_LO)}), {_lit(CLIP_HI)}) AS {_q(prefix + c)}")
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def numeric_bins(df: DataFrame, stages: Sequence[Transformer], cols: Sequence[str], prefix: str = "num_",
                 inner: str = "_sc_", bins: int = TREE_BINS) -> list[Transformer]:
    """Stages that replace each scaled column by the number of its quantile bin.

    A tree splits on order alone, so bin numbers at learned quantile edges
    offer the splits a histogram learner would, and a numeric column never
    has more than ``bins`` of them, however wide ``maxBins`` must be for the
    categorical ones.
    """
    if not cols:
        return []
    scaled = df
    for st in stages:
        scaled = st.transform(scaled)
    fr = [i / bins for i in range(1, bins)]
    row = scaled.agg(*[F.percentile_approx(F.col(inner + c), fr, 10_000).alias(f"e{i}")
                       for i, c in enumerate(cols)]).first()
    splits = [[-math.inf, *sorted({float(e) for e in row[f"e{i}"] or [0.0]}), math.inf] for i in range(len(cols))]
    return [Bucketizer(splitsArray=splits, inputCols=[inner + c for c in cols],
                       outputCols=[prefix + c for c in cols], handleInvalid="keep")]


def categorical_stages(cols: Sequence[str], prefix: str = "cat_", encoding: str = "onehot") -> list[Transformer]:
    """T1 (constant 'missing') + T3: sorted categories.

    ``onehot``: sparse one-hot block, unseen -> all-zero block (the indexer
    keeps an extra slot that the encoder drops) — for linear models.
    ``index``: the category index itself, carrying nominal metadata, so tree
    learners split on categories directly; unseen values get the indexer's
    extra slot. Spark's trees hold one bin index per row and feature, so a
    4,000-wide one-hot block costs 4,000 slots per row where the index costs 1.
    """
    cols = list(cols)
    if not cols:
        return []
    fill = ("SELECT *, " + ", ".join(f"coalesce(CAST({_q(c)} AS STRING), '{MISSING}') AS {_q('_s_' + c)}"
                                     for c in cols) + " FROM __THIS__")
    if encoding == "index":
        idx = StringIndexer(inputCols=[f"_s_{c}" for c in cols], outputCols=[prefix + c for c in cols],
                            handleInvalid="keep", stringOrderType="alphabetAsc")
        return [SQLTransformer(statement=fill), idx]
    idx = StringIndexer(inputCols=[f"_s_{c}" for c in cols], outputCols=[f"_i_{c}" for c in cols],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[prefix + c for c in cols],
                        dropLast=True, handleInvalid="error")
    return [SQLTransformer(statement=fill), idx, ohe]


def max_category_arity(pipeline_model) -> int:
    """Largest number of index slots over the fitted string indexers."""
    from pyspark.ml.feature import StringIndexerModel
    arity = 0
    for st in pipeline_model.stages:
        if isinstance(st, StringIndexerModel):
            for labels in st.labelsArray:
                arity = max(arity, len(labels) + 1)  # + the 'keep' slot
    return arity


def char_count_stage(vocabulary: Sequence[str], columns: Sequence[str], prefix: str = "seq_") -> SQLTransformer:
    """T4 as a stage: one count column per vocabulary character; the text is put together once a row."""
    text = "lower(concat(" + ", ".join(f"coalesce(CAST({_q(c)} AS STRING), '')" for c in columns) + "))"
    parts, s = [], "_seq_text"
    for i, ch in enumerate(vocabulary):
        lit = ch.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"CAST(length({s}) - length(replace({s}, '{lit}', '')) AS DOUBLE) AS {_q(prefix + str(i))}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM (SELECT *, {text} AS {s} FROM __THIS__)")


def assembler(blocks: Sequence[str], output: str = "features") -> VectorAssembler:
    """T5: numeric, one-hot and character blocks into one (sparse) vector."""
    return VectorAssembler(inputCols=list(blocks), outputCol=output, handleInvalid="keep")


def feature_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Output feature names from the vector column's ML attributes."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    names = {}
    for kind in attrs.values():
        for a in kind:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    size = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(size)]

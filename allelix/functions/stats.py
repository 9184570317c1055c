"""Numeric Column helpers: inverse normal CDF, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: published rational approximation of the normal quantile
# (P. J. Acklam, 2003; relative error below 1.15e-9) ------------------------
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_P_LOW = 0.02425
# ---------------------------------------------------------------------------


def _horner_sql(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF of SQL expression ``p``, as SQL text."""
    p = f"CAST({p} AS DOUBLE)"
    ql = f"sqrt(-2.0D * ln({p}))"
    lo = f"({_horner_sql(_C, ql)} / ({_horner_sql(_D, ql)} * {ql} + 1.0D))"
    qh = f"sqrt(-2.0D * ln(1.0D - {p}))"
    hi = f"(-{_horner_sql(_C, qh)} / ({_horner_sql(_D, qh)} * {qh} + 1.0D))"
    q = f"({p} - 0.5D)"
    r = f"({q} * {q})"
    mid = f"({_horner_sql(_A, r)} * {q} / ({_horner_sql(_B, r)} * {r} + 1.0D))"
    return (f"CASE WHEN {p} <= 0 THEN CAST('-Infinity' AS DOUBLE) "
            f"WHEN {p} >= 1 THEN CAST('Infinity' AS DOUBLE) "
            f"WHEN {p} < {_P_LOW!r} THEN {lo} WHEN {p} > {1 - _P_LOW!r} THEN {hi} ELSE {mid} END")


def norm_ppf(p: Column | str) -> Column:
    """Inverse standard normal CDF as a native Column expression (no UDF)."""
    if isinstance(p, str):
        return F.expr(norm_ppf_sql(f"`{p}`"))
    raise TypeError("norm_ppf takes a column name; use norm_ppf_sql for expressions")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (x / nullif(den, 0))."""
    return num / F.when(den != 0, den)

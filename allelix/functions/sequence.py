"""Sequence and consequence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
BASES = ("A", "C", "G", "T")  # counted case-sensitively (upper case only)
SEVERITY_RULES = (("frameshift", 3.0), ("missense", 2.0))  # first match wins
SEVERITY_DEFAULT = 0.5
# ---------------------------------------------------------------------------


def char_count(s: Column, ch: str) -> Column:
    """Occurrences of one literal character (vectorised, no regex)."""
    return (F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))).cast("int")


def sequence_columns(seq: Column) -> dict[str, Column]:
    """P5 columns for a sequence column; NULL counts as ''."""
    s = F.coalesce(seq, F.lit(""))
    out = {"allele_length": F.length(s).cast("int")}
    for b in BASES:
        out[f"allele_{b}_count"] = char_count(s, b)
    gc = out["allele_G_count"] + out["allele_C_count"]
    out["allele_GC_content"] = gc.cast("double") / F.greatest(out["allele_length"], F.lit(1))
    return out


def severity(consequence: Column) -> Column:
    """Substring severity; NULL consequence is text 'nan' (no match)."""
    c = F.coalesce(consequence, F.lit("nan"))
    out = None
    for needle, w in SEVERITY_RULES:
        cond = c.contains(needle)
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out.otherwise(F.lit(SEVERITY_DEFAULT))

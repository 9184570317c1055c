"""Label text -> class (P1-P4) as native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
# Ordered rules, first match wins; substrings are tested on lower-cased text.
DEFAULT_LABEL_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("pathogenic", ("pathogenic",)),
    ("benign", ("benign",)),
    ("uncertain", ("uncertain", "conflicting")),
)
# Class codes: three-class and binary mode.
THREE_CLASS_CODES = {"benign": 0, "pathogenic": 1, "uncertain": 2}
BINARY_CLASS_CODES = {"non_pathogenic": 0, "pathogenic": 1}
BINARY_COLLAPSE = {"benign": "non_pathogenic", "uncertain": "non_pathogenic"}
# ---------------------------------------------------------------------------


def class_codes(binary: bool) -> dict[str, int]:
    return dict(BINARY_CLASS_CODES if binary else THREE_CLASS_CODES)


def class_names(binary: bool) -> list[str]:
    """Class names ordered by their code."""
    codes = class_codes(binary)
    return sorted(codes, key=codes.get)


def label_class(text: Column | str,
                rules: Sequence[tuple[str, Sequence[str]]] = DEFAULT_LABEL_RULES) -> Column:
    """First rule whose substring occurs in lower(text); NULL otherwise."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for cls, needles in rules:
        cond = None
        for n in needles:
            c = t.contains(n)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(cls)) if out is None else out.when(cond, F.lit(cls))
    return out if out is not None else F.lit(None).cast("string")


def collapse_binary(cls: Column | str) -> Column:
    """Benign, uncertain -> non_pathogenic; other classes unchanged."""
    c = F.col(cls) if isinstance(cls, str) else cls
    out = c
    for src, dst in BINARY_COLLAPSE.items():
        out = F.when(c == src, F.lit(dst)).otherwise(out)
    return out


def encode_class(cls: Column | str, codes: dict[str, int]) -> Column:
    """Class name -> int code (NULL for names outside the table)."""
    c = F.col(cls) if isinstance(cls, str) else cls
    out = None
    for name, code in codes.items():
        out = (F.when(c == name, F.lit(code)) if out is None
               else out.when(c == name, F.lit(code)))
    return out.cast("int")

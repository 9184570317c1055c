"""Quality rules as a bitmask ledger (operator 10).

``ledger`` measures every document once and evaluates every rule once: the
failed rules are bits of ``fail_bits``, stored beside the measurements. What
a rejection means is decided afterwards: a ``Policy`` is a version name and a
mask of enforced rules, and a document is kept when ``fail_bits & mask = 0``.
Policies are therefore re-applied, compared and ablated without reading a
text again. Only Spark SQL functions run, no Python on the executors.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words, so it fails the
length rule; a null or repeated id is carried through untouched, one ledger
row per input row. An empty table gives an empty ledger. Other columns of
the input never reach the expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 5 * word_chars"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 30 * n_words"),
    Rule("upper_case", 5, "100 * n_upper > 60 * word_chars"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(r.name for r in RULES))


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def _words(text: Column) -> Column:
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: as the only element
    of an array it becomes a lambda variable, which no rewrite copies into
    the inner loops that use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    (window hash, position) pairs are sorted inside the row, n log n in its
    own length, and only where a distinct count shows that a window repeats.
    """
    windows = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def twice(ranked: Column) -> Column:
        same = F.filter(ranked, lambda e, k: F.coalesce(F.get(ranked, k + 1)["h"] == e["h"], F.lit(False)) | (
            (k > 0) & (F.get(ranked, F.greatest(k - 1, F.lit(0)))["h"] == e["h"])))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(w)) < F.size(w)
        return F.when(some, _let(pairs, lambda r: _let(twice(r), covered))).otherwise(F.lit(0).cast("bigint"))

    return F.coalesce(_let(windows, count), F.lit(0).cast("bigint"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements), one row per input row."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    counted = _let(_words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    # a line has a word when anything is left after taking the spaces out
    lines = _let(F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != ""), lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    without = lambda chars: (F.length(text) - F.length(_without(text, chars))).cast("bigint")
    found = base.select(id_col, counted.alias("_w"), lines.alias("_l"),
                        F.length(_without(text, SPACES)).cast("bigint").alias("word_chars"),
                        without(SYMBOLS).alias("n_symbols"), without(UPPER).alias("n_upper"))
    return found.select(id_col, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
                        "_l.n_lines", "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, measurements, fail_bits): bit ``r.bit`` is set where rule r fails."""
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def verdict(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> Column:
    """Kept under the policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def apply_policies(book: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` per policy."""
    return book.withColumns({f"kept_{p.version}": verdict(p, rules) for p in policies})


def ablations(book: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(version, rule, failed, only_this, kept, kept_without), a row per enforced rule.

    The ledger is first reduced to counts by ``fail_bits`` (at most
    2^len(rules) groups, partial aggregation); ablating rule r under mask m
    is then bit arithmetic: a document comes back without r when
    ``fail_bits & m`` is exactly r's bit.
    """
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: 1 << r.bit for r in rules}
    cells = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"),
                 F.lit(bit[name]).cast("bigint").alias("bit"), F.lit(p.mask(rules)).cast("bigint").alias("mask"))
        for p in policies for name in p.rules]))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return (counts.select("fail_bits", "n", cells.alias("c"))
            .groupBy(F.col("c.version").alias("version"), F.col("c.rule").alias("rule"))
            .agg(n(F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0).alias("failed"),
                 n(hit == F.col("c.bit")).alias("only_this"),
                 n(hit == 0).alias("kept"),
                 n((hit == 0) | (hit == F.col("c.bit"))).alias("kept_without")))


def keep_good(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The input rows that the policy keeps, all their columns unchanged.

    The measurements are computed beside each row (no join back), so repeated
    and null ids need no special case.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(text_col).alias("_body"))
    book = ledger(whole, "_row", "_body")
    return book.where(verdict(policy)).select("_row.*")

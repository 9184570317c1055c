"""Character counts over concatenated sequence columns (T4).

``CharCounts.fit`` learns the sorted vocabulary of lower-cased characters
(``explode`` + partial ``distinct``; the vocabulary is size-checked).
``transform`` adds one count column per vocabulary character with
``length(s) - length(replace(s, ch, ''))`` — no explode, no shuffle.
``long_form`` gives (key, ch, n) rows for n > 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import bounded_rows


def concat_sequences(columns) -> Column:
    """Lower-cased concatenation; NULL parts read as ''."""
    return F.lower(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


@dataclass
class CharCounts:
    columns: tuple = ("allele", "allele_string")
    prefix: str = "seq_"
    max_vocab: int = 100_000
    vocabulary: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> "CharCounts":
        cols = [c for c in self.columns if c in df.columns]
        self.columns = tuple(cols)
        chars = (df.select(F.explode(F.array_distinct(F.split(concat_sequences(cols), ""))).alias("ch"))
                 .where(F.col("ch") != "").distinct())
        rows = bounded_rows(chars, self.max_vocab, "character vocabulary")
        self.vocabulary = sorted(r["ch"] for r in rows)
        return self

    def count_columns(self) -> dict[str, Column]:
        s = concat_sequences(self.columns)
        return {f"{self.prefix}{i}": (F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))).cast("int")
                for i, ch in enumerate(self.vocabulary)}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.count_columns())

    def long_form(self, df: DataFrame, key: str) -> DataFrame:
        counts = self.count_columns()
        cells = F.array(*[F.struct(F.lit(ch).alias("ch"), counts[f"{self.prefix}{i}"].alias("n"))
                          for i, ch in enumerate(self.vocabulary)])
        return (df.select(key, F.explode(cells).alias("c"))
                .select(key, "c.ch", F.col("c.n").cast("long").alias("n")).where(F.col("n") > 0))

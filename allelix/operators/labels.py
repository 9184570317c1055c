"""Labelling operators (P1-P4) and class tables (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (DEFAULT_LABEL_RULES, class_codes, class_names,
                                collapse_binary, encode_class, label_class)


def prepare_target(df: DataFrame, *, text_col: str = "clinical_significance",
                   binary: bool = False, rules=DEFAULT_LABEL_RULES,
                   class_col: str = "mapped_target", code_col: str = "target_encoded") -> DataFrame:
    """P1 + P2 + P3 + P4: label text -> class -> code; unlabelled rows dropped."""
    cls = label_class(text_col, rules)
    if binary:
        cls = collapse_binary(cls)
    out = df.withColumn(class_col, cls).where(F.col(class_col).isNotNull())
    return out.withColumn(code_col, encode_class(class_col, class_codes(binary)))


def class_distribution(df: DataFrame, class_col: str = "mapped_target") -> DataFrame:
    """A1: rows per class, largest first, with the share of all rows.

    The per-class table is tiny (one row per class), so the share window
    over it runs on an already-aggregated frame.
    """
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share).orderBy(F.desc("n"), class_col)


def class_counts(df: DataFrame, *, binary: bool = False,
                 class_col: str = "mapped_target") -> DataFrame:
    """A2: count per class in the mode's fixed class order, 0 for absent ones."""
    spark = df.sparkSession
    order = spark.createDataFrame(
        [(i, c) for i, c in enumerate(class_names(binary))], "class_pos INT, cls STRING")
    counts = df.groupBy(F.col(class_col).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(order).join(counts, "cls", "left")
            .select("class_pos", F.col("cls").alias(class_col),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .orderBy("class_pos"))

"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: declared variant columns ---------------------------------
STRING_COLUMNS = ("gene", "chromosome", "variant_id", "consequence_type",
                  "clinical_significance", "population_name", "region",
                  "allele", "allele_string")
NUMERIC_COLUMNS = ("allele_freq", "allele_count", "sample_size", "position")
# texts that mean "missing" in a CSV field
NULL_MARKERS = ("", "NA", "N/A", "n/a", "#N/A", "<NA>", "NaN", "nan", "-NaN", "-nan", "NULL", "null", "None")
# ---------------------------------------------------------------------------
_CORRUPT = "_malformed_line"


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, ...]:
    # read the header line only (one row, no inference, no full scan)
    first = spark.read.option("header", False).option("sep", sep).csv(path).limit(1).collect()
    return tuple((c or "").strip().lstrip("\ufeff") for c in first[0]) if first else ()


def header_census(spark: SparkSession, path: str | list[str], sep: str = ",",
                  parallelism: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder or pattern by their header line. A file costs
    one read of its first line; files without a line are left out."""
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        headers = list(pool.map(lambda f: _header(spark, f, sep), files))
    census: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers):
        if header:
            if len(set(header)) < len(header):
                raise ValueError(f"a column name is repeated in the header of {file}")
            census.setdefault(header, []).append(file)
    return dict(sorted(census.items()))


def _lines(spark: SparkSession, files: str | list[str], cols: Sequence[str], sep: str, own_header: bool) -> DataFrame:
    """All columns as text, and ``_CORRUPT``: the whole line where it has more or fewer fields than columns."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in (*cols, _CORRUPT)])
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
            .option("enforceSchema", own_header)
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(files))


def _census_lines(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame | None:
    parts = [_lines(spark, files, header, sep, True) for header, files in header_census(spark, path, sep).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_variants_csv(spark: SparkSession, path: str | list[str], sep: str = ",",
                      columns: list[str] | None = None) -> DataFrame:
    """S1 + S2: header CSV with declared types; absent columns are left out.

    Every column is read as text (no schema inference pass), texts of
    ``NULL_MARKERS`` become NULL, then the numeric columns are coerced with
    ``try_cast`` so bad text becomes NULL too. Files are grouped by their
    header line, each group is read by its own names and the groups are united
    by name, so files may differ in the order and number of their columns; a
    column that a file lacks is NULL in its rows. With ``columns`` the files
    must have exactly these in this order, another header is an error. A line
    with too few fields is filled with NULL, one with too many is cut;
    ``malformed_lines`` lists both.
    """
    if columns:
        df = _lines(spark, path, columns, sep, False)
    else:
        df = _census_lines(spark, path, sep)
        if df is None:
            return spark.createDataFrame([], T.StructType([]))
    cols = [c for c in df.columns if c != _CORRUPT]
    known = df.select([F.when(~F.col(f"`{c}`").isin(*NULL_MARKERS), F.col(f"`{c}`")).alias(c) for c in cols])
    return coerce_numeric(known)


def malformed_lines(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, line) of the lines whose number of fields isn't their header's."""
    parts = []
    for header, files in header_census(spark, path, sep).items():
        # all columns are parsed: with a pruned list Spark doesn't see what a line has too many or too few of
        seen = _lines(spark, files, header, sep, True).withColumn("_file", F.input_file_name())
        whole = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in header])) >= 0
        parts.append(seen.where(F.col(_CORRUPT).isNotNull() & whole)
                     .select(F.col("_file").alias("file"), F.col(_CORRUPT).alias("line")))
    if not parts:
        return spark.createDataFrame([], "file string, line string")
    return reduce(DataFrame.unionByName, parts)


def read_variants_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S1 for Parquet: the file's own types; numeric columns coerced if text."""
    return coerce_numeric(spark.read.parquet(path))


def coerce_numeric(df: DataFrame, columns=NUMERIC_COLUMNS) -> DataFrame:
    """Named columns -> DOUBLE via try_cast, NaN -> NULL; absent names are skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))") for c in present})


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """S3: metric table sink (CSV with header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)

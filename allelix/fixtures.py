"""Stand-in inputs derived from the driver's test tables.

The test tables hold no variants, so these views only *re-label* TPC-H-ish rows
into the schemas the operators expect (see FIXTURES.md). They do none of the
operators' work. Each view is defined once as SQL expression text so that the
Spark view and the DuckDB oracle CTE are the same derivation.

V  variants    lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region
P  predictions scored rows (h, pop, y, p0, p1, p2, yhat, yhat2)
C  rule codes  long form (h, pop, slot, code)
VL learnable   V plus a binary target y_learn
L  documents   documents ⋈ labels (doc_id, grp, n_chars, y)
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# shared SQL fragments (valid in Spark SQL and DuckDB)
# ---------------------------------------------------------------------------
_H = ("md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
      "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)))")


def _d(i: int) -> str:
    return f"substr(h, {i}, 1)"


def _dna(x: str) -> str:
    return f"translate({x}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _hexval(x: str) -> str:
    return f"(instr('0123456789abcdef', {x}) - 1)"


# label texts for hex digits 0..b of d(2), in digit order
_LABEL_TEXTS = ("Pathogenic|Likely pathogenic|Conflicting interpretations of pathogenicity|"
                "pathogenic,risk factor|Benign|Likely benign|benign/likely benign|"
                "Uncertain significance|uncertain|conflicting data|association|drug response")
# rule codes for hex digits 0..9 (a-f carry none)
_CODE_TEXTS = "PVS1|PS1|PM2|PP1|PP3|BA1|BS1|BP4|PM1|XX9"

# V: variant columns from the joined base row (h already computed)
V_COLUMNS = [
    "h AS variant_id",
    "p_brand AS gene",
    "r_name AS chromosome",
    "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS position",
    f"CASE WHEN {_d(1)} IN ('0','1') THEN 'frameshift_variant' "
    f"WHEN {_d(1)} IN ('2','3','4') THEN 'missense_variant' "
    "ELSE lower(p_type) END AS consequence_type",
    # label text by hex digit 2 (0..b); c-f give NULL
    f"nullif(split_part('{_LABEL_TEXTS}', '|', CAST({_hexval(_d(2))} + 1 AS INT)), '') "
    "AS clinical_significance",
    "CASE WHEN substr(h, 3, 2) = '00' THEN NULL ELSE n_name END AS population_name",
    "l_returnflag AS region",
    f"CASE WHEN substr(h, 5, 2) = '00' THEN NULL ELSE {_dna('substr(h, 7, l_linenumber)')} END AS allele",
    f"CASE WHEN {_d(4)} = '0' THEN NULL ELSE concat({_dna(_d(20))}, '/', {_dna(_d(21))}) END AS allele_string",
    f"CASE WHEN {_d(15)} = '0' THEN NULL ELSE l_discount END AS allele_freq",
    "l_quantity AS allele_count",
    "l_extendedprice AS sample_size",
]

_BASE_SQL = (
    f"SELECT {_H} AS h, l.*, p_brand, p_type, n_name, r_name "
    "FROM lineitem l JOIN part ON l_partkey = p_partkey "
    "JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)

_X = [f"({_hexval(_d(i))} * 256 + {_hexval(_d(i + 1))} * 16 + {_hexval(_d(i + 2))}) / CAST(4096 AS DOUBLE)"
      for i in (9, 12, 15)]
_Y = f"({_hexval(_d(2))} % 3)"


def _b(k: int) -> str:
    return (f"({_X[k]} + CAST(0.01 AS DOUBLE) + CASE WHEN {_Y} = {k} "
            "THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")


_BSUM = f"({_b(0)} + {_b(1)} + {_b(2)})"

P_COLUMNS = [
    "h",
    "n_name AS pop",
    f"CAST({_Y} AS INT) AS y",
] + [f"CAST(round({_b(k)} / {_BSUM}, 3) AS DOUBLE) AS p{k}" for k in range(3)]

_P_YHAT = ["CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS yhat",
           # a coarser second predictor (probabilities floored to one decimal),
           # standing in for the other arm's predictions
           "CAST(CASE WHEN floor(p0 * 10) >= floor(p1 * 10) AND floor(p0 * 10) >= floor(p2 * 10) THEN 0 "
           "WHEN floor(p1 * 10) >= floor(p2 * 10) THEN 1 ELSE 2 END AS INT) AS yhat2"]

# C: one slot per hex digit 22, 23, 24; a-f carry no code
_CODE_CASE = (f"nullif(split_part('{_CODE_TEXTS}', '|', CAST({_hexval('d')} + 1 AS INT)), '')")

_GC_UNNULLED = (
    f"(length({_dna('substr(h, 7, l_linenumber)')}) - "
    f"length(replace(replace({_dna('substr(h, 7, l_linenumber)')}, 'G', ''), 'C', ''))) "
    f"/ CAST(greatest(length({_dna('substr(h, 7, l_linenumber)')}), 1) AS DOUBLE)"
)
VL_TARGET = (
    f"CAST(CASE WHEN {_d(25)} IN ('0','1') THEN "
    f"CASE WHEN {_GC_UNNULLED} > 0.5 THEN 0 ELSE 1 END "
    f"ELSE CASE WHEN {_GC_UNNULLED} > 0.5 THEN 1 ELSE 0 END END AS INT) AS y_learn"
)


def _sql_list(cols):
    return ",\n  ".join(cols)


# DuckDB CTEs (the oracle side reads the pre-registered views)
V_CTE = f"v AS (SELECT {_sql_list(V_COLUMNS)} FROM ({_BASE_SQL}) b)"
VL_CTE = f"vl AS (SELECT {_sql_list(V_COLUMNS + [VL_TARGET])} FROM ({_BASE_SQL}) b)"
P_CTE = (f"p AS (SELECT *, {', '.join(_P_YHAT)} FROM (SELECT {_sql_list(P_COLUMNS)} FROM ({_BASE_SQL}) b) q)")
C_CTE = (
    "c AS (SELECT h, n_name AS pop, slot, " + _CODE_CASE.replace("d)", "substr(h, slot, 1))")
    + f" AS code FROM ({_BASE_SQL}) b CROSS JOIN (VALUES (22), (23), (24)) s(slot)"
    + " WHERE substr(h, slot, 1) NOT IN ('a','b','c','d','e','f'))"
)
L_CTE = ("l AS (SELECT d.doc_id, d.lang AS grp, d.n_chars, lb.quality AS y "
         "FROM documents d JOIN labels lb ON d.doc_id = lb.doc_id)")


# ---------------------------------------------------------------------------
# Spark views
# ---------------------------------------------------------------------------
def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimension tables
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # part and supplier grow with the data: Spark's size-checked join choice
    # (autoBroadcastJoinThreshold / AQE) decides, no forced broadcast
    base = (li.join(part, li.l_partkey == part.p_partkey)
            .join(sup, li.l_suppkey == sup.s_suppkey)
            .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("h", F.expr(_H)))
    # Not stored: every view over it is, and that is where the filters of a
    # query stop, so none of them is pushed into the derivations and hashes a row again.
    return base


def _stored(df: DataFrame) -> DataFrame:
    # a stand-in view behaves like a stored table: its derived columns are
    # computed once per session, not re-derived inside every query's filters
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture V: the variant table a user of the library brings."""
    return _stored(_base(spark, sf_dir).selectExpr(*V_COLUMNS))


def variants_learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture VL: V plus a learnable binary target ``y_learn``."""
    return _stored(_base(spark, sf_dir).selectExpr(*(V_COLUMNS + [VL_TARGET])))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture P: scored rows (true class, class probabilities, argmax class)."""
    return _stored(_base(spark, sf_dir).selectExpr(*P_COLUMNS).selectExpr("*", *_P_YHAT))


def rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C, long form: one row per (variant, slot) carrying a rule code."""
    b = _base(spark, sf_dir).select("h", "n_name")
    slots = F.explode(F.array(F.lit(22), F.lit(23), F.lit(24))).alias("slot")
    return _stored(b.select("h", F.col("n_name").alias("pop"), slots)
                   .withColumn("code", F.expr(_CODE_CASE.replace("d)", "substr(h, slot, 1))")))
                   .where(F.col("code").isNotNull()))


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture L: documents joined with quality labels; language is the group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (d.join(lb, "doc_id")
            .select("doc_id", F.col("lang").alias("grp"), "n_chars", F.col("quality").alias("y")))

"""Secret scan with corpus-wide ownership frequency (operator 9).

Base candidates (``assign``, ``access``, ``hex``) come from fixed patterns in
every whole text; a fourth kind, ``token``, is a proposal of the method: a
random-looking word that no pattern names. Every candidate's value is hashed, and the corpus is asked how many
distinct repositories and owners hold it. Exact copies of a text count as one
holder, the first of its owners and repositories, so that a crossposted document isn't
many. A value with more than ``max_owners`` owners of distinct texts, with more
than ``max_repos`` repositories of one owner, or in one text that more than
``max_owners + 1`` owners hold, is a widely copied example (documentation, test
data, a licence key of a template); any other that looks random is live-looking. Base spans are always kept and only graded;
``token`` proposals become spans only if they are live-looking.

Owners and repositories are columns of the table (by default ``source`` and
the document). The counts are partial aggregates by (value, owner), then by
value; a value that a third of all documents hold is one row per task before
the shuffle, and its grade returns over a join that Spark can split.

Null texts have no candidates. A null owner is an owner of its own. Rows that
repeat an id get equal results. An empty table gives an empty result. A
document without candidates is a row with zeros.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.session import cut_lineage

KINDS = ("assign", "access", "hex", "token")
MAX_OWNERS = 1
MAX_REPOS = 20  # of one owner
MIN_BITS = 3.5  # Shannon bits per character of a live-looking value
# fixed patterns of the base kinds; letters of the names in either case
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_NAMED = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
MIN_ASSIGN, MIN_ACCESS = 12, 18


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value), leftmost non-overlapping per kind."""
    found = []
    if _NAMED.search(text):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # runs are maximal, so {16,} equals dropping shorter matches of [0-9a-f]+
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Live-looking: varied characters, and more than one class of them."""
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return entropy(value) >= (3.0 if re.fullmatch("[0-9a-f]+", value) else MIN_BITS) and classes >= 2


def proposals(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Words of three character classes with high entropy outside the base spans."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        a, z = m.span()
        v = m[0]
        if not any(s < z and a < e for s, e, *_ in base) and looks_random(v) \
                and re.search("[a-z]", v) and re.search("[A-Z]", v) and len(re.findall("[0-9]", v)) >= 3:
            out.append((a, z, 3, v))
    return out


SPAN = "array<struct<start:int,stop:int,kind:int,value:bigint,random:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()),
                               ("value", pa.int64()), ("random", pa.bool_())]))
    for b in batches:
        rows = []
        for text in b.column("_text").to_pylist():
            base = base_spans(text) if text else []
            every = base + (proposals(text, base) if text else [])
            rows.append([{"start": a, "stop": z, "kind": k, "random": looks_random(v),
                          "value": xxhash.xxh3_64_intdigest(v.encode()) - 2**63} for a, z, k, v in every])
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_th"), b.column("_owner"), b.column("_repo"), pa.array(rows, kind)],
            ["_id", "_th", "_owner", "_repo", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id") -> DataFrame:
    """(_id, _th, _owner, _repo, found): candidates of every row, values as 64-bit hashes."""
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_th"),
                        F.col(owner_col).cast("string").alias("_owner"), F.col(repo_col).cast("string").alias("_repo"),
                        F.col(text_col).alias("_text"))
    return named.mapInArrow(_scan, f"_id bigint, _th bigint, _owner string, _repo string, found {SPAN}")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(value, n_hits, n_repos, n_owners, copied) of every candidate value of the corpus.

    The counts are of all rows; ``copied`` is judged on distinct texts (see above).
    """
    hits = found.select("_th", "_owner", "_repo", F.explode("found.value").alias("value"))
    # one row per repository, then per owner, then per value: each step combines inside tasks first
    repos = hits.groupBy("value", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("value", "_owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    counts = owners.groupBy("value").agg(
        F.sum("n").alias("n_hits"), F.sum("r").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    # the same over texts: the owners of a text, its one holder, then the holders of a value
    spread = hits.groupBy("value", "_th", "_owner").agg(F.min(F.struct("_owner", "_repo")).alias("h"))
    texts = spread.groupBy("value", "_th").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("o"))
    held = texts.groupBy("value", F.col("h._owner").alias("_owner"), F.col("h._repo").alias("_repo")).agg(F.max("o").alias("o"))
    each = held.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("r"), F.max("o").alias("o"))
    wide = each.groupBy(F.col("value").alias("_value")).agg(
        ((F.count(F.lit(1)) > max_owners) | (F.max("r") > max_repos) | (F.max("o") > max_owners + 1)).alias("copied"))
    return counts.join(wide, F.col("value") == F.col("_value")).drop("_value")


def graded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(id, spans): per row, its spans (start, stop, kind, n_owners, n_repos, copied, live).

    Base spans are all there; ``token`` spans only where live-looking.
    """
    # few rows of numbers, read by the count and by the join: the texts are scanned once
    found = scan(docs, id_col, text_col, owner_col, repo_col).withColumn(
        "_row", F.monotonically_increasing_id()).transform(cut_lineage)
    owned = ownership(found, max_owners, max_repos)
    each = found.where(F.size("found") > 0).select("_row", F.explode("found").alias("s")).join(
        owned, F.col("s.value") == F.col("value"))
    live = F.col("s.random") & ~F.col("copied")
    spans = (each.where((F.col("s.kind") < 3) | live)
             .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(  # bounded by the row's own text
                 F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"),
                 "n_owners", "n_repos", "copied", live.alias("live")))).alias("spans")))
    none = F.array().cast(spans.schema["spans"].dataType)
    return (found.select("_row", "_id").join(spans, "_row", "left")
            .select(F.col("_id").alias(id_col), F.coalesce("spans", none).alias("spans")))


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spans) -> the digest columns of the query."""
    for b in batches:
        rows = []
        for spans in b.column("spans").to_pylist():
            names = [(KINDS[s["kind"]], f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}") for s in spans]
            n = Counter(k for k, _ in names)
            base = ",".join(x for k, x in names if k != "token")
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(),
                         ",".join(x for _, x in names), n["token"], sum(s["live"] for s in spans),
                         sum(s["copied"] for s in spans)))
        cols = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                         [x.split()[0] for x in DIGEST.split(", ")])


DIGEST = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
          "n_token bigint, n_live bigint, n_copied bigint")

"""URL filter: rules, then a character language-model ratio (operator 1).

Rules (host, path) decide the urls they fit; the urls they decide are also
the labelled text of two variable-order Markov models, accepted and rejected.
A url without a rule is judged by the models: the mean over its characters of
log P(c | context, accepted) - log P(c | context, rejected), compared with a
threshold calibrated on labelled urls that the scoring models had not seen.

* Characters fall into ``len(ALPHABET) + 2`` classes (letters, one digit class,
  url signs, "other", start/end), contexts have up to ``ORDER`` of them. So a model has
  at most 44^(ORDER+1) counts whatever the corpus: the counts are aggregated
  over all labelled urls, summed inside each task before the shuffle, and
  the table on the driver has a fixed bound (ORDER = 3: 3.7 million cells).
* Smoothing: Witten-Bell. A context of length k trusts its own counts with
  weight n / (n + distinct followers) and its shorter suffix with the rest, so
  the order used varies with the evidence.
* Calibration: the labelled urls fall into two halves by a hash of the url.
  Each half is scored by models of the other half, the score histograms are
  aggregated, and the threshold with the best balanced accuracy is taken. The
  final models count all labelled urls.

A null url, or one without ``://``, has empty host and path and fits no rule;
an empty one has score 0. If one of the classes has no url, all scores are 0
and the threshold is 0: no evidence rejects nothing (score >= threshold is
allowed). Ids are carried through; repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:~+@,;"  # "0" stands for every digit
OTHER, EDGE = len(ALPHABET), len(ALPHABET) + 1
K = len(ALPHABET) + 2
BINS = 4001  # of scores from -LIMIT to LIMIT
LIMIT = 10.0


@dataclass(frozen=True)
class HostRule:
    """``rule`` is host + path, as in ``example.com/de/``."""

    rule: str
    allow: bool

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits (host and subdomains, path prefix), or null."""
    best = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        best = F.when(fits, F.lit(r.rule)).otherwise(best)
    return best


# ---------------------------------------------------------------- the models
_CODE = np.full(256, OTHER, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
    _CODE[ord(_c.upper())] = _i
for _c in "123456789":
    _CODE[ord(_c)] = _CODE[ord("0")]


def codes(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All (ORDER+1)-gram codes of the urls and each url's number of them.

    Each url is preceded by ORDER edge marks and followed by one.
    """
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    pad, end = [EDGE] * ORDER, [EDGE]
    text = np.concatenate([x for r in raw for x in (pad, _CODE[np.frombuffer(r, np.uint8)], end)]) \
        if raw else np.zeros(0, np.int64)
    size = np.array([len(r) + 1 for r in raw], np.int64)
    grams = np.zeros(max(len(text) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        grams = grams * K + text[k:k + len(grams)]
    # the ORDER windows that would begin in one url and end in the next are left out
    last = np.cumsum(size + ORDER)[:-1]
    keep = np.ones(len(grams), bool)
    for k in range(1, ORDER + 1):
        keep[last - k] = False
    return grams[keep], size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[tuple[int, bool], np.ndarray] = {}
    for b in batches:
        url, half, good = (b.column(c).to_pylist() for c in ("url", "half", "good"))
        for key in set(zip(half, good)):
            grams, _ = codes([u for u, h, g in zip(url, half, good) if (h, g) == key])
            if key not in table:
                table[key] = np.zeros(K ** (ORDER + 1), np.int64)
            table[key] += np.bincount(grams, minlength=K ** (ORDER + 1))
    for (half, good), n in table.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), half, np.int32)), pa.array(np.full(len(at), good)), pa.array(at), pa.array(n[at])],
            ["half", "good", "gram", "n"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(url, half, good) -> (half, good, gram, n) over all rows, at most 4 K^(ORDER+1) rows."""
    per_task = labelled.mapInArrow(_count, "half int, good boolean, gram bigint, n bigint")
    return per_task.groupBy("half", "good", "gram").agg(F.sum("n").alias("n"))


def witten_bell(counts: np.ndarray) -> np.ndarray:
    """log P(last | the ORDER before it), a table of K^(ORDER+1)."""
    prob = np.full(K, 1.0 / K)
    for order in range(ORDER + 1):
        n = counts.reshape(K ** (ORDER - order), -1, K).sum(axis=0)  # context of this order x follower
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        # the suffix of a context is the context without its first character
        shorter = np.tile(prob.reshape(-1, K), (n.shape[0] // max(prob.size // K, 1), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            prob = np.where(total > 0, (n + kinds * shorter) / (total + kinds), shorter)
    return np.log(prob).ravel()


def ratio_table(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-likelihood differences by gram; all 0 where a class has no text."""
    if not good.any() or not bad.any():
        return np.zeros(K ** (ORDER + 1), np.float32)
    return (witten_bell(good) - witten_bell(bad)).astype(np.float32)


def scores(urls: Sequence[str | None], table: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per character (and end mark); 0 for an empty url."""
    if not len(urls):
        return np.zeros(0)
    grams, size = codes(urls)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    mean = np.add.reduceat(table[grams].astype(np.float64), start) / size
    return np.where(size > 1, mean, 0.0)


@dataclass
class UrlModel:
    table: np.ndarray
    threshold: float

    def score(self, df: DataFrame, url_col: str = "url", score_col: str = "score") -> DataFrame:
        """``df`` with the url's score; the broadcast table has K^(ORDER+1) floats."""
        shared = df.sparkSession.sparkContext.broadcast(self.table)

        def judge(batches):
            for b in batches:
                s = scores(b.column(url_col).to_pylist(), shared.value)
                yield b.append_column(score_col, pa.array(s, pa.float64()))

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{score_col} double"])
        return df.mapInArrow(judge, schema)


def fit(labelled: DataFrame, url_col: str = "url", good_col: str = "good") -> UrlModel:
    """Models and threshold from all rows of ``labelled`` (url, accepted or not)."""
    rows = labelled.where(F.col(good_col).isNotNull()).select(
        F.col(url_col).alias("url"), F.pmod(F.xxhash64(url_col), F.lit(2)).cast("int").alias("half"),
        F.col(good_col).cast("boolean").alias("good"))
    counts = np.zeros((2, 2, K ** (ORDER + 1)), np.int64)  # half, good, gram
    got = gram_counts(rows).toArrow()  # bounded by the alphabet, not by the corpus
    np.add.at(counts, tuple(got.column(c).to_numpy().astype(np.int64) for c in ("half", "good", "gram")),
              got.column("n").to_numpy())
    spark = labelled.sparkSession
    # row h scores half h with the counts of the other half
    crossed = spark.sparkContext.broadcast([ratio_table(counts[1 - h, 1], counts[1 - h, 0]) for h in (0, 1)])

    def held_out(batches):
        hist = np.zeros((2, BINS), np.int64)
        for b in batches:
            url, half, good = (b.column(c).to_pylist() for c in ("url", "half", "good"))
            for h in (0, 1):
                for g in (False, True):
                    s = scores([u for u, x, y in zip(url, half, good) if x == h and y == g], crossed.value[h])
                    hist[int(g)] += np.bincount(_bin(s), minlength=BINS)
        g, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(at), pa.array(hist[g, at])], ["good", "bin", "n"])

    found = (rows.mapInArrow(held_out, "good bigint, bin bigint, n bigint")
             .groupBy("good", "bin").agg(F.sum("n").alias("n")).toArrow())  # at most 2 * BINS rows
    hist = np.zeros((2, BINS), np.int64)
    np.add.at(hist, (found.column("good").to_numpy(), found.column("bin").to_numpy()), found.column("n").to_numpy())
    return UrlModel(ratio_table(counts[:, 1].sum(0), counts[:, 0].sum(0)), best_threshold(hist))


def _bin(s: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((s + LIMIT) / (2 * LIMIT) * BINS), 0, BINS - 1).astype(np.int64)


def best_threshold(hist: np.ndarray) -> float:
    """Lower edge of the bin from which accepting has the best balanced accuracy
    (the middle of the best bins on ties); 0 where a class is empty."""
    bad, good = hist
    if not good.sum() or not bad.sum():
        return 0.0
    kept_good = good[::-1].cumsum()[::-1] / good.sum()
    cut_bad = 1 - bad[::-1].cumsum()[::-1] / bad.sum()
    both = kept_good + cut_bad
    best = np.nonzero(both >= both.max() - 1e-12)[0]
    return float(best[len(best) // 2] / BINS * 2 * LIMIT - LIMIT)


def judge_urls(pages: DataFrame, rules: Sequence[HostRule], id_col: str = "page_id",
               url_col: str = "url", model: UrlModel | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict, else the model's.

    Without a ``model`` one is fitted on the urls that the rules decide.
    """
    parts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")).withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    allow = F.col("rule").isin([r.rule for r in rules if r.allow])
    if model is None:
        model = fit(ruled.where(F.col("rule").isNotNull()).select("url", allow.alias("good")))
    passes = F.when(F.col("rule").isNotNull(), allow).otherwise(F.col("score") >= F.lit(model.threshold))
    return model.score(ruled).select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.when(passes, "allow").otherwise("block").alias("verdict"), "score")

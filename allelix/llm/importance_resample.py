"""Importance resampling towards a target distribution (operator 11).

1. Features: runs of 1 to ``longest`` consecutive words of a whole text. Each
   batch interns its n-grams in an open-addressed table of NumPy arrays
   (``GramTable``): the xxhash64 of an n-gram gives its first slot, occupied
   slots are compared by key and then by bytes, and an occurrence that meets another
   n-gram goes on to the next slot. A slot holds its bucket (crc32 modulo
   ``buckets``) and its count, so the hash of the bucket is taken once per distinct
   n-gram, not once per occurrence.
2. Counts: every task adds its tables' counts up by bucket; the tasks' vectors
   are summed by a partial aggregation into one row per bucket.
3. Gains: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, from
   the corpus (s, S) and the target (t, T): ``buckets`` integers, whatever the
   input's size.
4. Weights: a second pass interns again; the occurrences' slot ids gather
   their gains, and a document's weight is the floored mean of them.
5. Draw: weight plus a seeded Gumbel number; the highest of these scores are a
   sample without replacement. Scores are integers of a narrow range, so a histogram of them
   gives the last score that is drawn and every score's first rank; only the
   drawn rows are sorted, score by score.

A null or empty text has no features and weight 0. Rows that repeat an id are
documents of their own with the same random number; a null id draws by the
text ``null`` and comes last among ties. An empty corpus or target gives gains from the
smoothing alone. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.session import cut_lineage

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# occurrences that one table interns (more where a single text has more)
TABLE_GRAMS = 250_000
# A-Z lower-cased; 0-9, a-z and all bytes of other characters stay, the rest separates
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def grams(raw: bytes | None, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """(number of words, all runs of 1 to ``longest`` words, joined by one space)."""
    words = raw.translate(_WORDS).split() if raw else []
    out = words
    for n in range(2, longest + 1):
        out = out + [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


class GramTable:
    """An open-addressed table of the distinct n-grams of a list.

    ``slot`` is each occurrence's slot; ``bucket`` and ``count`` are columns of
    the table, used where ``owner`` (the first occurrence that came) is not -1.
    """

    def __init__(self, occurrences: list[bytes], buckets: int = BUCKETS, key=xxhash.xxh64_intdigest, room: int = 2):
        n = len(occurrences)
        size = 1 << max(4, (room * n - 1).bit_length())  # at most half full
        keys = np.fromiter(map(key, occurrences), np.uint64, n)
        text = np.empty(n, object)
        text[:] = occurrences
        self.owner = np.full(size, -1, np.int64)
        self.slot = np.empty(n, np.int64)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            place = at[left]
            free = self.owner[place] < 0
            # of the occurrences that meet at a free slot the first one takes it
            self.owner[place[free][::-1]] = left[free][::-1]
            owner = self.owner[place]
            same = keys[owner] == keys[left]
            same[same] = text[owner[same]] == text[left[same]]
            self.slot[left[same]] = place[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (size - 1)
        self.used = np.nonzero(self.owner >= 0)[0]
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = np.fromiter(map(zlib.crc32, text[self.owner[self.used]]), np.int64,
                                             len(self.used)) % buckets


def _tables(batch: pa.RecordBatch, longest: int, buckets: int):
    """(row numbers, words, features, table) for some rows of the batch at a time."""
    rows, words, sizes, held = [], [], [], []
    for i, raw in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
        n, found = grams(raw, longest)
        rows.append(i)
        words.append(n)
        sizes.append(len(found))
        held += found
        if len(held) >= TABLE_GRAMS:
            yield rows, words, sizes, GramTable(held, buckets)
            rows, words, sizes, held = [], [], [], []
    if rows:
        yield rows, words, sizes, GramTable(held, buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST,
                  buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket: ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, table in _tables(b, longest, buckets):
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    per_task = texts.select(F.col(text_col).alias("_text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in per_task.groupBy("bucket").agg(F.sum("n")).collect():  # at most a row per bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The integer gain of each bucket."""
    b = len(corpus)
    s_all, t_all = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """The document's seeded Gumbel number, in thousandths."""
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
           longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(_id, n_words, n_features, weight, score), a row per document."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("_id").to_pylist()
            for rows, words, sizes, table in _tables(b, longest, buckets):
                each = gain[table.bucket][table.slot]  # an occurrence's gain, by its slot
                ends = np.cumsum(sizes)
                sums = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends])]
                weight = [int(z - a) // n if n else 0 for a, z, n in zip(sums[:-1], sums[1:], sizes)]
                own = [ids[i] for i in rows]
                cols = [own, words, sizes, weight, [w + gumbel(i, seed) for i, w in zip(own, weight)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["_id", "n_words", "n_features", "weight", "score"])

    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(score, "_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def draw(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... for the drawn ones, else null.

    Of the documents with at least ``min_words`` words, ``percent`` in 100 are
    drawn by descending score, ties by ascending id.
    """
    rows = rows.transform(cut_lineage)  # five numbers a document, read three times
    fit = F.col("n_words") >= min_words
    # a score is a weight (|1000 ln| of a ratio of counts) plus -3,200 .. 22,900: a few ten thousand values
    per_score = sorted(rows.where(fit).groupBy("score").count().collect(), reverse=True)
    take = percent * sum(r["count"] for r in per_score) // 100
    first, before = [], 0
    for score, n in per_score:
        if before >= take:
            break
        first.append((score, before))
        before += n
    last = first[-1][0] if first else None
    spark = rows.sparkSession
    starts = spark.createDataFrame(first, "_score bigint, _before bigint")
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    chosen = fit & (F.col("score") >= F.lit(last))
    within = Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_last(), "n_features", "weight")
    drawn = (rows.where(chosen).withColumn("_nth", F.row_number().over(within))
             .join(F.broadcast(starts), F.col("score") == F.col("_score"))
             .withColumn("rank", (F.col("_before") + F.col("_nth")).cast("bigint"))
             .withColumn("rank", F.when(F.col("rank") <= F.lit(take), F.col("rank")))
             .drop("_nth", "_score", "_before"))
    return drawn.unionByName(rows.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(_id, n_words, n_features, weight, score, rank), a row per document of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets),
                 bucket_counts(target, target_text_col, longest, buckets))
    return draw(scored(docs, gain, id_col, text_col, longest, seed), percent, min_words)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged. Ids are taken to be distinct and known here."""
    ranks = resample(docs, target, id_col, **options).where("rank IS NOT NULL").select(F.col("_id").alias(id_col))
    return docs.join(ranks, id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Phrase collocations by the stripes pattern (operator 12).

A piece of a text (between stops and line ends) gives one entry per word
position: the prefix of two words that starts there and the word behind it,
or nothing where the piece ends. The stripe of a prefix is its associative
next-word counter.

1. Each task numbers its words, packs an entry into one 64-bit key and sorts
   some million keys at a time; equal keys are one counter element.
   Elements go out in lines, one message per (language, bucket); the bucket is a
   hash of the whole prefix, so a frequent first word is spread over all
   buckets. The empty prefix has a stripe too, the word counts, dealt by word.
2. A bucket's messages are merged element by element. A merged stripe gives at
   once the prefix's total f(w1 w2), its extensions f(w1 w2 w3) and the highest count among
   them, which decides whether the prefix is subsumed. The stripes that end in
   the prefix (x w1 w2) are the extensions of other stripes: their highest count
   is one more maximum per pair.
3. Candidates (``min_count`` occurrences) are joined with the counts of their
   two parts for each cut; the lowest-scoring cut counts. Products are exact
   (decimal numbers of 38 digits: counts up to 10^16).
4. The first ``top`` of each language are selected in three steps of ever
   fewer groups, so no task sorts all candidates of a language.

The buckets' number follows the corpus (``BUCKET_BYTES`` of text each), so a
bucket's counters fit a task at any size. A null text is empty, a null language
is ``und``; rows that repeat are counted again. An empty table, or one
without frequent phrases, gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.session import cut_lineage

MIN_COUNT = 10
PERCENT = 50
TOP = 2000
BUCKET_BYTES = 4_000_000
# entries that a task sorts at a time, bytes of text that it splits at a time
SORT_KEYS = 1_000_000
PART_BYTES = 2_000_000
PART_TOKENS = 500_000
_BITS = 21
_STOP = b"."
# A-Z lower-cased, [.,;:!?\x0A-\x0D] as one stop, a tab as a space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c
               for c in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Words and stops of a text, in order."""
    return raw.translate(_TABLE).replace(_STOP, b" . ").split()


class _Numbers(dict):
    """word -> 1, 2, ...; a stop is 0."""

    def __init__(self):
        super().__init__({_STOP: 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.words)
        self.words.append(word)
        return value


class Stripes:
    """The stripes of some texts, as messages for the buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.keys: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Take in texts; full tables come out."""
        stream = tokens(_STOP.join(texts)) + [_STOP, _STOP]
        for lo in range(0, len(stream) - 2, PART_TOKENS):
            part = stream[lo:lo + PART_TOKENS + 2]
            if self.held > SORT_KEYS or len(self.numbers.words) + len(part) > 1 << _BITS:
                yield from self.flush()
            n = np.fromiter(map(self.numbers.__getitem__, part), np.uint64, len(part))
            w1, w2, w3 = n[:-2], n[1:-1], n[2:]
            w3 = np.where(w2 > 0, w3, np.uint64(0))
            key = ((w1 << np.uint64(2 * _BITS)) | (w2 << np.uint64(_BITS)) | w3)[w1 > 0]
            self.keys.setdefault(lang, []).append(key)
            self.held += len(key)

    def flush(self) -> Iterator[pa.RecordBatch]:
        words = self.numbers.words
        crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        mask = np.uint64((1 << _BITS) - 1)
        for lang, parts in self.keys.items():
            keys = np.sort(np.concatenate(parts))
            if not len(keys):
                continue
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.nonzero(new)[0]
            count = np.diff(np.append(first, len(keys)))
            w1, w2, w3 = (keys[first] >> np.uint64(2 * _BITS)), (keys[first] >> np.uint64(_BITS)) & mask, keys[first] & mask
            # the stripe of the empty prefix: how often each word comes at all
            seen, at = np.unique(w1, return_index=True)
            totals = np.add.reduceat(count, at)
            yield from self._messages(lang, crc[seen] % np.uint64(self.buckets),
                                      [words[i] for i in seen.tolist()], totals)
            pair = w2 > 0
            w1, w2, w3, count = w1[pair], w2[pair], w3[pair], count[pair]
            bucket = ((crc[w1] * np.uint64(0x9E3779B1) + crc[w2]) * np.uint64(0x85EBCA77) >> np.uint64(8)) % np.uint64(self.buckets)
            lines = [b" ".join(x) for x in zip(*([words[i] for i in w.tolist()] for w in (w1, w2, w3)))]
            yield from self._messages(lang, bucket, lines, count)
        self._reset()

    @staticmethod
    def _messages(lang: str, bucket: np.ndarray, lines: list[bytes], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        cut = np.concatenate([[0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)]]) if len(order) else [0]
        text = [b"\n".join([lines[i] for i in order[a:z].tolist()]) for a, z in zip(cut[:-1], cut[1:])]
        counts = [count[order[a:z]].astype("<u4").tobytes() for a, z in zip(cut[:-1], cut[1:])]
        if text:
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order[cut[:-1]]].astype(np.int64)), pa.array([lang] * len(text)),
                 pa.array(text, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "lang", "lines", "counts"])


def _send(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stripes(buckets)
        for b in batches:
            waiting: dict[str, list[bytes]] = {}
            size = 0
            for lang, raw in zip(b.column("_lang").to_pylist(), b.column("_text").cast(pa.binary()).to_pylist()):
                if raw:
                    waiting.setdefault(lang, []).append(raw)
                    size += len(raw)
                if size > PART_BYTES:
                    for k, texts in waiting.items():
                        yield from own.add(k, texts)
                    waiting, size = {}, 0
            for k, texts in waiting.items():
                yield from own.add(k, texts)
        yield from own.flush()

    return send


_STATS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("head", pa.binary()),
                    ("rest", pa.binary()), ("last", pa.binary()), ("f", pa.int64()), ("inner", pa.int64())])


def _merge(min_count: int):
    def merge(table: pa.Table) -> pa.Table:
        """The bucket's stripes, merged: frequent words, pairs and triples, and the languages' word counts.

        ``inner`` is a pair's highest extension, a triple's prefix total.
        """
        by_lang: dict[str, dict[bytes, int]] = {}
        for lang, lines, counts in zip(*(table.column(c) for c in ("lang", "lines", "counts"))):
            counter = by_lang.setdefault(lang.as_py(), {})
            get = counter.get
            for line, n in zip(lines.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<u4").tolist()):
                counter[line] = get(line, 0) + n
        rows: list[tuple] = []
        for lang, counter in by_lang.items():
            n_words = 0
            stripes: dict[bytes, list[tuple[bytes, int]]] = {}
            for line, n in counter.items():
                prefix, pair, last = line.rpartition(b" ")
                if pair:
                    stripes.setdefault(prefix, []).append((last, n))
                else:
                    n_words += n
                    if n >= min_count:
                        rows.append((lang, 1, line, None, None, None, n, 0))
            rows.append((lang, 0, None, None, None, None, n_words, 0))
            for prefix, stripe in stripes.items():
                total = sum([n for _, n in stripe])
                if total < min_count:
                    continue
                w1, w2 = prefix.split(b" ")
                longer = [(w3, n) for w3, n in stripe if w3 and n >= min_count]
                rows.append((lang, 2, prefix, w1, w2, None, total, max([n for _, n in longer], default=0)))
                rows += [(lang, 3, prefix + b" " + w3, w1, w2 + b" " + w3, w3, n, total) for w3, n in longer]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _STATS)] if rows
                        else [pa.array([], f.type) for f in _STATS], schema=_STATS)

    return merge


def stripe_stats(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What the merged stripes say: a row per frequent word (size 1), pair (2)
    and triple (3), and the languages' word counts in parts (0)."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"),
                        F.col(text_col).alias("_text"))
    sent = named.mapInArrow(_send(buckets), "bucket bigint, lang string, lines binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(
        _merge(min_count), "lang string, size int, phrase binary, head binary, rest binary, last binary, f bigint, inner bigint")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 percent: int = PERCENT, top: int = TOP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases of two and three words that no longer candidate subsumes."""
    stats = stripe_stats(docs, text_col, lang_col, min_count, bucket_bytes).transform(cut_lineage)
    n = stats.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = stats.where("size = 1").select("lang", F.col("phrase").alias("w"), "f")
    pairs, triples = stats.where("size = 2"), stats.where("size = 3")
    # the stripes that a pair ends: the highest count in front of it
    before = triples.groupBy("lang", F.col("rest").alias("phrase")).agg(F.max("f").alias("ahead"))
    alone = (pairs.join(before, ["lang", "phrase"], "left")
             .where(F.greatest("inner", F.coalesce("ahead", F.lit(0))) * 100 < F.col("f") * percent))

    def count_of(table: DataFrame, key: str, part: str, name: str) -> DataFrame:
        return table.select("lang", F.col(key).alias(part), F.col("f").alias(name))

    two = (alone.join(count_of(words, "w", "head", "l1"), ["lang", "head"])
           .join(count_of(words, "w", "rest", "r1"), ["lang", "rest"])
           .select("lang", "phrase", "f", "l1", "r1", F.col("l1").alias("l2"), F.col("r1").alias("r2")))
    three = (triples.join(count_of(words, "w", "head", "l1"), ["lang", "head"])
             .join(count_of(pairs, "phrase", "rest", "r1"), ["lang", "rest"])
             .join(count_of(words, "w", "last", "r2"), ["lang", "last"])
             .select("lang", "phrase", "f", "l1", "r1", F.col("inner").alias("l2"), "r2"))
    cuts = two.unionByName(three).withColumn("s1", exact_score("f", "l1", "r1")).withColumn("s2", exact_score("f", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    scored = cuts.select("lang", "phrase", F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    ranked = first_of(scored, top)
    return ranked.join(n, "lang").select("lang", F.col("_nth").cast("bigint").alias("rank"),
                                         F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def exact_score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits."""
    d = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    return F.expr(f"CAST({d(a)} * {d(a)} * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div CAST({d(left)} * {d(right)} AS DECIMAL(38,0))")


def first_of(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each language with their place ``_nth``; binary phrases sort by their bytes."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for groups in (parts, 16, 1):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        scored = (scored.withColumn("_salt", salt)
                  .withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
                  .where(F.col("_nth") <= top).drop("_salt"))
    return scored

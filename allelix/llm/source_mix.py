"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

1. Sizes: words (``[^\\x20\\x09-\\x0D]+``) per document, summed per source.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating,
   and share ``total_share`` of all words. A target stops at ``max_repeat``
   times its source's size; the excess is shared again by weight until no
   target is above its limit. Each round is one aggregate over the table of
   sources.
3. Documents are dealt to shards by a seeded hash of their id, so a shard holds
   about ``shard_words`` words of all sources and no source, however large,
   is one group. In each shard the sources' blocks of ``block_words`` words
   are apportioned by highest quotients votes / (2 s + 1) (Sainte-Lague),
   where a source's votes are its words in the shard times its target / size,
   counted in blocks of its own mean width there (a short last block is no whole
   block). This gives an integer quota per (shard, source). What rounding takes or gives
   is dealt over the shards: votes and seats are moved by an offset of -1/2 to 1/2 block that
   runs evenly through the shards from a seeded start, so a source of a block a
   shard gets its target over all shards too.
4. The words of a (shard, source) pair, its documents in seeded order, are cut
   into equal blocks. A quota q over n blocks takes every block q // n times
   and q % n blocks, in seeded order, once more, so no block is taken more
   than ``max_repeat`` times.

Reruns agree: every order comes from a hash of ids and the seed, ties by id
and text. A null or empty text has size 0 and nothing is taken from it. Rows
that repeat an id are documents of their own. An empty table, or one
without words, gives targets of 0. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.operators.ordering import running_sum
from allelix.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 16
SHARD_WORDS = 2_000_000
SEED = 42


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # bytes.split() without an argument splits at exactly \x20 and \x09-\x0D
    for b in batches:
        sizes = [len(t.split()) if t else 0 for t in b.column("_text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_src"), b.column("_th"), pa.array(sizes, pa.int64())],
            ["_id", "_src", "_th", "size"])


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """(_id, _src, _th, size): a row per document, its text replaced by hash and word count."""
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(source_col).cast("string").alias("_src"),
                        F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return named.mapInArrow(_count_words, "_id bigint, _src string, _th bigint, size bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(_src, source_size, target), a row per source.

    The position of a source in code point order decides its weight; it comes
    from a skew-safe running count bucketed by the name's first characters,
    so no task sorts all sources.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    # UTF-8 byte order is code point order; "1" puts null behind every name
    key = F.when(F.col("_src").isNull(), "1").otherwise(F.concat(F.lit("0"), F.hex(F.encode("_src", "utf-8"))))
    order = running_sum(per.withColumn("_key", key).withColumn("_all", F.lit(0)), ["_all"], [F.col("_key")],
                        {"_rank": F.lit(1)}, bucket=F.substring("_key", 1, 9))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = order.select("_src", "source_size", w.alias("_w"),
                         (F.col("source_size") * F.lit(float(max_repeat))).alias("_most")).transform(cut_lineage)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, level = total * total_share, 0.0
    done = -1
    capped = F.lit(False)
    while True:
        row = table.agg(F.sum(F.when(~capped, F.col("_w"))).alias("w"),
                        F.sum(F.when(capped, F.col("_most")).otherwise(0.0)).alias("used"),
                        F.sum(capped.cast("int")).alias("n")).first()
        if not row["w"] or row["n"] == done:
            break
        done = row["n"]
        level = (left - row["used"]) / row["w"]  # words per unit of weight
        capped = F.col("_most") <= F.col("_w") * F.lit(level)
    target = F.least(F.col("_most"), F.col("_w") * F.lit(float(level)))
    return table.select("_src", "source_size", target.alias("target"))


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Integer seats by highest quotients votes / (2 s + 1), at most ``most`` each.

    The quotients above a divisor d number sum(floor(v / d + 1/2)); the
    largest d that still gives ``seats`` is found by bisection, and the last
    seats at one quotient go to the larger vote, then the earlier row.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum(dtype=float))) if len(votes) else 0
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def at(d: float) -> np.ndarray:
        return np.where(votes > 0, np.minimum(np.floor(votes / d + 0.5), most), 0).astype(np.int64)

    lo, hi = votes[votes > 0].min() / (2.0 * seats + 2.0) / 2.0, 4.0 * votes.max()
    while at(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if at(mid).sum() >= seats:
            lo = mid
        else:
            hi = mid
    got = at(hi)
    rest = seats - int(got.sum())
    if rest > 0:  # quotients tied at the last divisor
        order = np.lexsort((np.arange(len(votes)), -votes, -(at(lo) - got)))
        for i in order:
            give = min(rest, int(at(lo)[i] - got[i]))
            got[i] += give
            rest -= give
            if not rest:
                break
    return got


def _mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chosen_blocks(n_blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block is taken: quota spread evenly, the rest in seeded order."""
    taken = np.full(n_blocks, quota // n_blocks, np.int64)
    more = quota % n_blocks
    if more:
        with np.errstate(over="ignore"):
            rank = _mix64(np.arange(n_blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                          + np.uint64(seed % 2**64))
        taken[np.argsort(rank, kind="stable")[:more]] += 1
    return taken


def _offset(shard: int, start: int) -> float:
    """In [0, 1): neighbouring shards' offsets lie evenly (steps of the golden ratio)."""
    return (start / 2.0**64 + shard * 0.6180339887498949) % 1.0


def shard_quotas(shards: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT,
                 seed: int = SEED) -> DataFrame:
    """(_shard, _src, words, votes: words to take) -> the same with ``quota``.

    ``shards`` has a row per (shard, source): one group holds a shard's
    sources, already summed, never its documents.
    """

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_src", na_position="last", kind="stable")
        shard, words = int(pdf["_shard"].iloc[0]), pdf["words"].to_numpy()
        blocks = -(-words // block_words)
        votes = pdf["votes"].to_numpy() * blocks / np.maximum(words, 1)  # in blocks of the pair's mean width
        start = lambda name: xxhash.xxh64_intdigest(name, seed)
        own = [_offset(shard, start("null" if s is None else "0" + s)) for s in pdf["_src"].where(pdf["_src"].notna(), None)]
        moved = np.where(votes > 0, np.maximum(votes + np.array(own) - 0.5, 1e-9), 0.0)
        seats = math.floor(votes.sum() + _offset(shard, start("seats")))
        pdf["quota"] = sainte_lague(moved, seats, blocks * max_repeat)
        return pdf[["_shard", "_src", "quota"]]

    return shards.groupBy("_shard").applyInPandas(share, "_shard bigint, _src string, quota bigint")


def _take(block_words: int, seed: int):
    """One (shard, source): which word ranges of its documents are taken, how often."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "_id", "_th", "size"], kind="stable", na_position="last")
        size = pdf["size"].to_numpy()
        end = np.cumsum(size)
        words = int(end[-1])
        shard, quota = int(pdf["_shard"].iloc[0]), int(pdf["quota"].iloc[0])
        n = -(-words // block_words)
        if n and quota:
            # the seed is the shard's and its first document's: differs by source
            key = (shard * 1_000_003 + int(pdf["_u"].iloc[0]) + seed) % 2**64
            times = chosen_blocks(n, quota, key)
            # words taken before word w of the stream, per block edge
            width = np.full(n, block_words, np.int64)
            width[-1] = words - (n - 1) * block_words
            before = np.concatenate([[0], np.cumsum(times * width)])

            def taken_to(w: np.ndarray) -> np.ndarray:
                b = np.minimum(w // block_words, n)
                inside = np.where(b < n, (w - b * block_words) * times[np.minimum(b, n - 1)], 0)
                return before[b] + inside

            pdf["taken"] = taken_to(end) - taken_to(end - size)
            spans = []
            for a, z in zip(end - size, end):
                lo, hi = a // block_words, -(-z // block_words)
                part = times[lo:hi]
                if not len(part) or z == a:
                    spans.append([])
                    continue
                cut = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
                spans.append([[int(max(a, (lo + i) * block_words) - a), int(min(z, (lo + j) * block_words) - a),
                               int(part[i])] for i, j in zip(cut[:-1], cut[1:]) if part[i]])
            pdf["spans"] = spans
        else:
            pdf["taken"] = 0
            pdf["spans"] = [[] for _ in range(len(pdf))]
        return pdf[["_id", "_th", "_src", "size", "source_size", "target", "taken", "spans"]]

    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(_id, _th, _src, size, source_size, target, taken, spans), a row per document.

    ``spans`` are [from word, to word, times] of the document's taken words.
    """
    # the sizes are read by several jobs; without this each would read all texts
    sizes = word_sizes(docs, id_col, text_col, source_col).transform(cut_lineage)
    targets = source_targets(sizes, weights, total_share, max_repeat).transform(cut_lineage)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, -(-total // shard_words))
    u = F.xxhash64(F.col("_id"), F.col("_th"), F.lit(seed))
    dealt = sizes.withColumn("_u", u).withColumn("_shard", F.pmod("_u", F.lit(n_shards)))
    named = targets.withColumnRenamed("_src", "_tsrc")
    own = F.col("_src").eqNullSafe(F.col("_tsrc"))
    joined = dealt.join(named, own).drop("_tsrc")
    shards = (dealt.groupBy("_shard", "_src").agg(F.sum("size").alias("words")).join(named, own)
              .select("_shard", "_src", "words",
                      F.when(F.col("source_size") > 0, F.col("words") * F.col("target") / F.col("source_size"))
                      .otherwise(0.0).alias("votes")))
    quotas = shard_quotas(shards, block_words, max_repeat, seed).select(
        F.col("_shard").alias("_qshard"), F.col("_src").alias("_qsrc"), "quota")
    ready = joined.join(quotas, (F.col("_shard") == F.col("_qshard")) & F.col("_src").eqNullSafe(F.col("_qsrc")))
    # documents without words give nothing to a group: however many there are, none of them is sent to one
    taken = ready.drop("_qshard", "_qsrc").where("size > 0").groupBy("_shard", "_src").applyInPandas(
        _take(block_words, seed),
        "_id bigint, _th bigint, _src string, size bigint, source_size bigint, target double, taken bigint, "
        "spans array<array<bigint>>")
    return taken.unionByName(joined.where("size = 0").select(
        "_id", "_th", "_src", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"),
        F.array().cast("array<array<bigint>>").alias("spans")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix itself: input rows with only their taken words, columns unchanged.

    A document whose words are taken up to twice comes as up to two rows (the
    words taken at least once, and those taken again); untaken words go. Kept
    words keep the white space between them. ``n_chars``, where there is one,
    is the new length.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).where(F.col("taken") > 0)
    # rows equal in id and text have equal spans only by chance: number them on both sides
    key = ["_id", "_th"]
    nth = Window.partitionBy(*key).orderBy(F.to_json(F.struct("spans")))
    spans = taken.select(*key, "spans", F.row_number().over(nth).alias("_nth"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(id_col).cast("bigint").alias("_rid"), F.xxhash64(text_col).alias("_rth"))
    rows = rows.withColumn("_rnth", F.row_number().over(
        Window.partitionBy("_rid", "_rth").orderBy(F.to_json(F.struct(
            *[F.col(f"_row.`{c}`") for c in docs.columns if c != text_col])))))
    cond = (F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rth") == F.col("_th")) & (F.col("_rnth") == F.col("_nth")))
    hit = rows.join(spans, cond).select("_row", F.col(f"_row.{text_col}").alias("_text"), "spans")

    row_type = hit.schema["_row"].dataType.simpleString()
    cut = hit.mapInArrow(_cut_words, f"_row {row_type}, _new string")
    fields = []
    for c in docs.columns:
        if c == text_col:
            fields.append(F.col("_new").alias(c))
        elif c == "n_chars":
            fields.append(F.length("_new").cast(docs.schema[c].dataType).alias(c))
        else:
            fields.append(F.col(f"_row.`{c}`").alias(c))
    return cut.select(*fields)


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, new = [], []
        for i, (text, spans) in enumerate(zip(b.column("_text").to_pylist(), b.column("spans").to_pylist())):
            raw = text.encode("utf-8", "surrogatepass")
            start, end = word_edges(raw)
            for epoch in range(1, max(s[2] for s in spans) + 1):
                merged: list[list[int]] = []
                for lo, hi, times in spans:
                    if times >= epoch:
                        if merged and merged[-1][1] == lo:
                            merged[-1][1] = hi
                        else:
                            merged.append([lo, hi])
                if merged:
                    at.append(i)
                    new.append(b"\n".join(raw[start[lo]:end[hi - 1]] for lo, hi in merged).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [b.column("_row").take(pa.array(at, pa.int64())), pa.array(new, pa.string())], ["_row", "_new"])

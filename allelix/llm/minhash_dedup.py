"""Near-duplicate groups by one-permutation MinHash (operator 6).

1. Sketch: every document's set of word shingles is hashed once; the upper
   bits of a hash are its bin, the smallest hash of each of ``BINS`` bins is
   kept. An empty bin takes the value of the first filled bin in a fixed
   random order of its own (optimal densification: the order depends on the
   bin alone, so equal sets agree and different bins borrow independently).
   Documents with equal sets (128-bit hash of the whole set) form one class,
   and only classes go on.
2. Buckets: ``BANDS`` bands of ``ROWS`` values. At a similarity of 0.8 a pair shares
   no bucket with probability (1 - 0.8^4)^32 < 5e-8.
3. Stars: a bucket's class of the smallest id is its centre, and only (centre, member)
   pairs are candidates, so a bucket of m classes gives m - 1 pairs. Pairs are
   confirmed on the full sets, and the confirmed links joined to components.
4. The rest, exactly: a bucket within one component can't join anything more. The classes
   of all other buckets go through a prefix filter. Their shingles have one
   order: those of a single component first, then by rising frequency. If two sets are
   similar, their first common shingle has at least the needed overlap
   behind it (itself included) in both. So only a shingle that two components
   hold, early in both sets, makes a candidate, and long lists of frequent shingles
   or of a component's own shingles make none. Every pair left is confirmed on the
   full sets, so no link between members of a bucket is lost, whether or not
   they resemble its centre.
5. Components of all links; the smallest id is the representative.

A hot class is one row after a partial aggregation. The members of a hot
centre are spread by a salt over tasks, each with a copy of the centre's set,
and so is a long list of a shingle, whose largest component is never paired with itself.

Null or wordless texts have the empty set and are linked with nothing. Rows
that repeat an id are documents of their own; a null id counts as larger than
every other. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.session import cut_lineage

from .components import connected_components
from .shingles import mix64, release, shingle_set

BINS = 128
BANDS, ROWS = 32, 4
NO_ID = 2**63 - 1
# members of a centre that one task compares
SALT_ROWS = 5_000
# shingles that a task hands on at a time
BATCH_SHINGLES = 500_000
_BIN_BITS = np.uint64(64 - (BINS - 1).bit_length())
_EDGES = np.arange(BINS, dtype=np.uint64) << _BIN_BITS
# row i: the order in which bin i asks the other bins
_ASK = np.random.default_rng(6).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted, non-empty set."""
    at = np.searchsorted(hashes, _EDGES)
    low = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (low >> _BIN_BITS == np.arange(BINS, dtype=np.uint64))
    empty = np.nonzero(~full)[0]
    if len(empty):
        ask = _ASK[empty]
        low[empty] = low[ask[np.arange(len(empty)), full[ask].argmax(axis=1)]]
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = low.reshape(BANDS, ROWS)
    for k in range(ROWS):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return acc


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))


def _sketches(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, hi, lo, bands = [], [], [], []
            for text in b.column("_text").to_pylist():
                s = shingle_set(text, n)
                h = xxhash.xxh3_128_digest(s.tobytes())
                size.append(len(s))
                hi.append(int.from_bytes(h[:8], "big", signed=True))
                lo.append(int.from_bytes(h[8:], "big", signed=True))
                bands.append(band_keys(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_th"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["_id", "_th", "n", "hi", "lo", "bands"])
        release()

    return rows


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """(_id, _th, n, hi, lo, bands) of every row; n is the set's size, (hi, lo) its hash."""
    return _named(docs, id_col, text_col).mapInArrow(
        _sketches(n), "_id bigint, _th bigint, n bigint, hi bigint, lo bigint, bands array<bigint>")


def _sets(n: int):
    """(node, size, _text) -> (node, size, hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, held, start = [], 0, 0
            for i, text in enumerate(b.column("_text").to_pylist()):
                sets.append(shingle_set(text, n).tobytes())
                held += len(sets[-1])
                if held > 8 * BATCH_SHINGLES or i == b.num_rows - 1:
                    part = b.slice(start, len(sets))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("size"), pa.array(sets, pa.binary())],
                                                     ["node", "size", "hashes"])
                    sets, held, start = [], 0, i + 1
        release()

    return rows


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, component, hashes) -> a row per shingle."""
    names = ["node", "size", "component"]
    for b in batches:
        for i in range(b.num_rows):
            own = np.frombuffer(b.column("hashes")[i].as_buffer(), np.int64)
            for lo in range(0, len(own), BATCH_SHINGLES):
                part = own[lo:lo + BATCH_SHINGLES]
                same = [pa.repeat(b.column(c)[i], len(part)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(part), *same], ["shingle", *names])


def _compare(percent: int):
    """Rows sorted by centre, salt, centre first -> (c, node) of the pairs that are similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for b in batches:
            hit_c, hit_x = [], []
            sets = b.column("hashes")
            for i, (c, member, x) in enumerate(zip(*(b.column(k).to_pylist() for k in ("c", "member", "node")))):
                s = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not member:
                    centre, own = c, s.copy()
                    continue
                if c != centre:
                    raise RuntimeError("a member came before its centre")
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                both = int((own[at] == s).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    hit_c.append(c)
                    hit_x.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(hit_c, pa.int64()), pa.array(hit_x, pa.int64())], ["a", "b"])

    return rows


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (c, x) whose full sets are similar, as (a, b)."""
    degree = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    members = pairs.join(degree, "c").select(
        F.col("x").alias("node"), "c", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"),
        F.lit(True).alias("member"))
    centres = degree.select("c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(
        F.col("c").alias("node"), "c", "salt", F.lit(False).alias("member"))
    placed = members.unionByName(centres).join(sets.select("node", "hashes"), "node")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "c", "salt").sortWithinPartitions("c", "salt", "member")
    return dealt.select("c", "member", "node", "hashes").mapInArrow(_compare(percent), "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                percent: int = 80) -> DataFrame:
    """(_id, _th, n_shingles, component, group), a row per input row; the component is
    the smallest id that links reach, the group a number of this run that
    tells groups apart even where rows repeat an id (null for the empty set)."""
    # sizes, hashes and band keys: some hundred bytes a document, read by all later steps
    rows = sketches(docs, id_col, text_col, n).transform(cut_lineage)
    grouped = (rows.where("n > 0").groupBy("hi", "lo")
               .agg(F.min(F.struct("_id", "_th")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
               .select("hi", "lo", "least.*", "n", "bands").transform(cut_lineage))
    nodes = grouped.withColumn("node", F.monotonically_increasing_id())  # over stored rows: always the same
    links = _links(nodes, _named(docs, id_col, text_col), n, percent)
    comps = connected_components(links)
    named = (nodes.select("hi", "lo", "_id", "node").join(comps, "node", "left")
             .withColumn("component", F.coalesce("component", "node")).drop("node"))
    tops = named.groupBy("component").agg(F.min("_id").alias("top"))
    classes = named.join(tops, "component").select("hi", "lo", "top", F.col("component").alias("group"))
    return rows.join(classes, ["hi", "lo"], "left").select(
        "_id", "_th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("top")).otherwise(F.col("_id")).alias("component"),
        F.when(F.col("n") > 0, F.col("group")).alias("group"))


def _links(nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect whatever similar classes share a bucket."""
    keyed = nodes.select("node", "_id", F.col("n").alias("size"), F.explode("bands").alias("key"))
    # the smallest id is more often what the others were copied from than any other member
    centres = (keyed.groupBy("key").agg(F.min_by("node", "_id").alias("c"), F.count(F.lit(1)).alias("m"))
               .where("m > 1").select("key", "c"))
    members = keyed.drop("_id").join(centres, "key").transform(cut_lineage)
    wanted = members.select("node").distinct().join(nodes.select("node", "_id", "_th", F.col("n").alias("size")), "node")
    # the texts cross the network once; what follows reads the sets of those classes that share a bucket
    sets = (wanted.join(docs, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
            .select("node", "size", "_text").mapInArrow(_sets(n), "node bigint, size bigint, hashes binary")
            .transform(cut_lineage))
    alike = F.least("size", "c_size") * 100 >= F.greatest("size", "c_size") * percent  # else never similar
    c_sizes = nodes.select(F.col("node").alias("c"), F.col("n").alias("c_size"))
    stars = (members.where("node != c").select("c", "node", "size").distinct().join(c_sizes, "c").where(alike)
             .select("c", F.col("node").alias("x")))
    links = confirmed(stars.transform(cut_lineage), sets, percent).transform(cut_lineage)
    label = connected_components(links)
    named = members.select("key", "node").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    spans = (named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("key"))
    left = named.join(spans, "key").select("node", "component").distinct()
    rest = _prefix_pairs(sets.join(left, "node"), percent).transform(cut_lineage)
    return links.unionByName(confirmed(rest, sets, percent)).transform(cut_lineage)


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, x) of different components whose sets can be similar, from (node, size, component, hashes).

    ``left`` counts a set's shingles from this one to its most frequent; two sets are
    similar only if (100 + percent) * overlap >= percent * (size + size).
    """
    rows = sets.select("node", "size", "component", "hashes").mapInArrow(
        _shingles, "shingle bigint, node bigint, size bigint, component bigint")
    shared = (rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"),
                                          F.max("component").alias("hi"))
              .where("lo < hi").select("shingle", "df"))
    order = Window.partitionBy("node").orderBy(F.desc("df"), "shingle")
    early = (rows.join(shared, "shingle").withColumn("left", F.row_number().over(order).cast("bigint"))
             .where(F.col("left") * 100 >= F.col("size") * percent)
             .select("shingle", "node", "size", "component", "left").transform(cut_lineage))
    # the component with most rows of a list is not paired with itself
    top = (early.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
           .groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("t"), F.sum("k").alias("m"),
                                   F.count(F.lit(1)).alias("parts"))
           .where("parts > 1")
           .select("shingle", F.col("t.component").alias("top"),
                   F.ceil(F.col("m") / F.lit(SALT_ROWS)).cast("int").alias("salts")))
    listed = early.join(top, "shingle")
    here = listed.where("component != top").select(
        "shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("p"),
        F.col("size").alias("p_size"), F.col("component").alias("p_component"), F.col("left").alias("p_left"))
    there = listed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    enough = (F.least("left", "p_left") * (100 + percent) >= (F.col("size") + F.col("p_size")) * percent)
    alike = F.least("size", "p_size") * 100 >= F.greatest("size", "p_size") * percent
    # two rows outside the largest component meet from both sides: once is enough
    once = (F.col("component") == F.col("top")) | (F.col("node") < F.col("p"))
    return (there.join(here, ["shingle", "salt"])
            .where((F.col("component") != F.col("p_component")) & enough & alike & once)
            .select(F.least("node", "p").alias("c"), F.greatest("node", "p").alias("x")).distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     percent: int = 80) -> DataFrame:
    """The input with one row of each near-duplicate group (the smallest id), columns unchanged.

    Rows without words are in no group and all stay.
    """
    groups = near_groups(docs, id_col, text_col, n, percent)
    one = (groups.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct("_id", "_th")).alias("k"))
           .select("k.*"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(text_col).alias("_th"),
                       (F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "") != "").alias("_some"))
    # rows equal in id and text are one group: the first by content stays
    nth = Window.partitionBy("_id", "_th").orderBy(F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in docs.columns
                                                                        if c != text_col])))
    kept = rows.where("_some").join(one, ["_id", "_th"], "left_semi").withColumn(
        "_nth", F.row_number().over(nth)).where("_nth = 1")
    return kept.select("_row.*").unionByName(rows.where("NOT _some").select("_row.*"))

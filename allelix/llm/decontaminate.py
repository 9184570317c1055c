"""Benchmark decontamination by spaced seeds (operator 7), DataFrame functions only.

Tokens are lower-cased words without punctuation. A seed covers ``SPAN``
tokens; a mask picks which of them are hashed, so a changed token under an
ignored position doesn't break the seed. Items and documents are hashed at all their
positions: any ``SPAN`` equal tokens in a row share a seed wherever they stand,
and masks find most that are interrupted.

1. Join: document seeds meet item seeds on the hash. The item side is broadcast
   if its counted rows fit ``BROADCAST_ROWS``; beyond that Spark shuffles.
2. Verify: document and item are laid side by side on the hit's diagonal, as far
   as both reach. Of all stretches of which at least ``PERCENT`` of the tokens are
   equal the one with the most equal tokens counts, wherever its changed tokens
   stand. The document is contaminated if it has at least ``MIN_MATCHES`` equal
   tokens; of an item shorter than that, ``PERCENT`` of its tokens.

Items of fewer than ``SPAN`` tokens can't be told from ordinary text and are
not searched. A null or short text has no seeds and is clean. A null id is an
ordinary value; rows that repeat an id are judged on their own texts, rows that
repeat id and text have one verdict each. An empty benchmark leaves all clean.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.session import cut_lineage

MASKS = ("11011011", "10111101", "11100111")
SPAN = 8
MIN_MATCHES, PERCENT = 13, 80
BROADCAST_ROWS = 1_000_000  # of two or three longs: some 30 MB
PUNCTUATION = ".,;:!?\"'()[]{}*#%$&|<>`_"


def token_hashes(text: Column) -> Column:
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION + "\t\n\x0b\x0c\r",
                       " " * (len(PUNCTUATION) + 5))
    return F.transform(F.array_remove(F.split(bare, " "), ""), lambda w: F.xxhash64(w))


def _seeds(texts: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """(keep.., at, key0, key1, key2): a row per position, a hash per mask.

    The tokens of a position are zipped to one row and hashed in compiled code
    (lambdas aren't compiled). The token array comes out of a generator, so that
    no filter inferred for the next one computes it again below."""
    each = texts.select(*keep, F.explode(F.array(tokens)).alias("_h"))
    last = F.greatest(F.size("_h") - (SPAN - 1), F.lit(0))
    rows = F.arrays_zip(*[F.slice("_h", k + 1, last).alias(f"t{k}") for k in range(SPAN)])
    placed = each.select(*keep, F.posexplode(rows).alias("at", "_s"))
    return placed.select(*keep, "at", *[
        F.xxhash64(F.lit(m), *[F.col("_s").getField(f"t{k}") for k in range(SPAN) if mask[k] == "1"]).alias(f"key{m}")
        for m, mask in enumerate(MASKS)])


def _by_key(seeds: DataFrame, *keep: str) -> DataFrame:
    """A row per position and mask instead."""
    return seeds.select(*keep, "at", F.explode(F.array(*[f"key{m}" for m in range(len(MASKS))])).alias("key"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its counted rows fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _th, at, item, item_at): where a seed of a document equals one of an item."""
    ours = (_by_key(_seeds(items, F.col("tokens"), "item"), "item").withColumnRenamed("at", "item_at")
            .distinct().transform(cut_lineage))
    theirs = _seeds(docs, token_hashes(F.col("_text")), "_id", "_th")
    if ours.count() > BROADCAST_ROWS:
        both = _by_key(theirs, "_id", "_th").join(ours, "key")
    else:  # one broadcast, looked up three times a position: only positions with a hit become rows
        places = ours.groupBy("key").agg(F.collect_list(F.struct("item", "item_at")).alias("places"))
        found = [f"places{m}" for m in range(len(MASKS))]
        for m, c in enumerate(found):
            theirs = theirs.join(F.broadcast(places.select(F.col("key").alias(f"key{m}"), F.col("places").alias(c))),
                                 f"key{m}", "left")
        some = theirs.where(F.coalesce(*found).isNotNull())
        each = some.select("_id", "_th", "at", F.explode(F.array_compact(F.array(*found))).alias("_p"))
        both = each.select("_id", "_th", "at", F.explode("_p").alias("_p")).select("_id", "_th", "at", "_p.item", "_p.item_at")
    return both.select("_id", "_th", "at", "item", "item_at").distinct()


def _longest(doc: Column, item: Column) -> Column:
    """(matches, length) of the stretch with the most equal tokens among those at
    least ``PERCENT`` equal; ``doc`` and ``item`` are aligned and equally long.

    A longest stretch lies between two changed tokens (or the ends): the k-th at
    position p has height 100 p - cost k, and changes a < b bound a good stretch
    if b isn't lower than a by more than a constant. So only new lows from the
    left and new highs from the right can be ends, and one walk pairs them."""
    cost = 10_000 // (100 - PERCENT)  # of a changed token, in hundredths of a position
    ends = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(doc) - 1),
                                                 lambda i: F.get(doc, i) != F.get(item, i)), F.array(F.size(doc)))
    points = F.transform(ends, lambda p, k: F.struct(p.alias("p"), k.alias("k"), (100 * p - cost * k).alias("h")))
    none = F.slice(points, 1, 0)

    def records(values: Column, beats) -> Column:
        return F.aggregate(values, none, lambda s, x: F.when(
            (F.size(s) == 0) | beats(x["h"], F.get(s, F.size(s) - 1)["h"]), F.concat(s, F.array(x))).otherwise(s))

    return F.get(F.transform(F.array(F.struct(
        records(points, lambda x, y: x < y).alias("a"),
        F.reverse(records(F.reverse(points), lambda x, y: x > y)).alias("b"))), _paired(cost)), 0)


def _paired(cost: int):
    def pair(r: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            a, b = F.get(r["a"], s["i"]), F.get(r["b"], s["j"])
            length = b["p"] - a["p"] - 1
            matches = length - (b["k"] - a["k"] - 1)
            # length * 100 >= cost * changed
            good = b["h"] - a["h"] >= 100 - cost
            return F.when(a.isNull() | b.isNull(), s).when(good, F.struct(
                s["i"].alias("i"), (s["j"] + 1).alias("j"), F.greatest(s["best"], F.struct(
                    matches.alias("matches"), length.alias("length"))).alias("best"))).otherwise(
                F.struct((s["i"] + 1).alias("i"), s["j"].alias("j"), s["best"].alias("best")))

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"),
                        F.struct(F.lit(0).alias("matches"), F.lit(0).alias("length")).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(r["a"]) + F.size(r["b"])), zero, step, lambda s: s["best"])

    return pair


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(_id, _th, item, matches, length): verified overlaps, the best of each (document, item)."""
    named = _named(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).alias("item"), token_hashes(F.col(item_text_col)).alias("tokens"))
    # a diagonal is judged once, whatever its hits; few rows, read three times
    found = hits(named, items).select("_id", "_th", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    found = found.transform(cut_lineage)
    # texts of documents with hits alone go on
    some = named.join(_small(found.select("_id", "_th").distinct()).select(
        F.col("_id").alias("_hid"), F.col("_th").alias("_hth")),
        F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth")), "left_semi")
    hashed = some.select(F.col("_id").alias("_did"), F.col("_th").alias("_dth"),
                         token_hashes(F.col("_text")).alias("doc")).distinct()
    wide = (found.join(hashed, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dth")))
            .join(items.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item")))
            .select("_id", "_th", "item", F.size("tokens").alias("n"), "doc", "tokens",
                    F.greatest("shift", F.lit(0)).alias("a"), F.greatest(-F.col("shift"), F.lit(0)).alias("b")))
    length = F.least(F.size("doc") - F.col("a"), F.size("tokens") - F.col("b"))
    # out of a generator: the slices aren't computed again in each use
    side = wide.select("_id", "_th", "item", "n", F.explode(F.array(F.struct(
        F.slice("doc", F.col("a") + 1, length).alias("doc"), F.slice("tokens", F.col("b") + 1, length).alias("tokens")))).alias("s"))
    whole = side.select("_id", "_th", "item", "n", F.explode(F.array(_longest(F.col("s.doc"), F.col("s.tokens")))).alias("o")).select(
        "_id", "_th", "item", "n", "o.matches", "o.length")
    need = F.when(F.col("n") < MIN_MATCHES, F.ceil(F.col("n") * PERCENT / 100)).otherwise(MIN_MATCHES)
    good = whole.where(F.col("matches") >= need)
    best = good.groupBy("_id", "_th", "item").agg(F.max(F.struct("matches", "length")).alias("b"))
    return best.select("_id", "_th", "item", "b.matches", "b.length")


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contaminated, n_items, matches, items) of every row; ``items`` are the
    ids of the items found, in order, ``matches`` the most equal tokens of one overlap."""
    per = overlaps(docs, benchmark, id_col, text_col).groupBy("_id", "_th").agg(
        F.count(F.lit(1)).alias("n"), F.max("matches").alias("m"), F.sort_array(F.collect_list("item")).alias("i"))
    per = per.select(F.col("_id").alias("_pid"), F.col("_th").alias("_pth"), "n", "m", "i")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    out = rows.join(per, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_th") == F.col("_pth")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").isNotNull().alias("contaminated"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("m", F.lit(0)).cast("bigint").alias("matches"),
                      F.coalesce(F.array_join("i", ","), F.lit("")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The clean input rows, columns unchanged."""
    bad = overlaps(docs, benchmark, id_col, text_col).select(
        F.col("_id").alias("_bid"), F.col("_th").alias("_bth")).distinct().transform(cut_lineage)
    return docs.join(_small(bad), F.col(id_col).eqNullSafe(F.col("_bid"))
                     & (F.xxhash64(text_col) == F.col("_bth")), "left_anti")

"""Substring deduplication by relative Lempel-Ziv parsing (operator 13).

A word goes if a window of ``size`` words that covers it also starts in a document
with a smaller id. Documents are dealt into blocks, and every block is parsed
against references that hold what it can share with smaller documents:

1. Anchors. A window's anchor is the lowest hash of its runs of ``GRAM`` words, a
   function of the window's words alone, so equal windows have equal anchors. Each
   block sends its distinct anchors, with the smallest document that has each, to hash
   buckets. A bucket tells the block which anchors other documents have;
   windows of other anchors can't repeat. It also names a reference block for
   each shared anchor: the holders, by ascending document, form a tree in
   which each serves at most ``FAN`` others, so a passage that a third of all
   documents share loads no single block.
2. References. A block that is asked for anchors sends the stretches of words
   around them, once per asking block, neighbouring ones merged.
3. Parse. The asking block indexes the windows of its references and of its own
   documents by hash, smallest document first, and factors its documents
   greedily: at the first indexed window of a smaller document the match is extended word
   by word as far as it goes. A factor of ``size`` words or more is a duplicate
   span, and the parse goes on with the windows that cross its end.
4. Factor boundaries. Windows outside all factors whose anchor is shared may still be
   repeated in a document that was no reference; their hashes meet in buckets,
   which answer whether a smaller document has them. First occurrences go this way, so
   the answer is exact, whatever the references held.

A block's text, references and hashes are bounded by ``block_bytes`` (and by its longest
text). Every step is a function of the rows: a lost executor's part is
computed again to the same result. Windows are told apart by 64-bit hashes,
factors by each of their words' hashes.

A null text is empty; a text of fewer than ``size`` words keeps all. A null id
counts as larger than every other; rows that repeat an id don't remove each
other's words. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 13
GRAM = 5
FAN = 64
BLOCK_BYTES = 4_000_000
NO_ID = 2**63 - 1
_P = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2^64
_LOW40 = np.uint64(2**40 - 1)


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)
# words of more bytes are hashed one by one; text that is hashed at a time
LONG_WORD = 64
CHUNK_BYTES = 1 << 20
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """1, P, P^2, ... and their inverses modulo 2^64; kept between a worker's tasks."""
    if len(_POWERS[0]) < n:
        n += n // 4
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    return _POWERS[0], _POWERS[1]


def word_edges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word."""
    space = np.ones(len(buf) + 2, np.int8)
    space[1:-1] = _SPACE[buf]
    edge = np.diff(space)
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, by differences of running sums over their bytes."""
    out = np.empty(len(start), np.uint64)
    power, back = _powers(CHUNK_BYTES + LONG_WORD)
    cut = np.searchsorted(start, np.arange(0, len(buf) + CHUNK_BYTES, CHUNK_BYTES))
    for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        first = k * CHUNK_BYTES
        part = _BYTES[buf[first:first + CHUNK_BYTES + LONG_WORD]]
        part *= power[:len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        a, z = start[lo:hi] - first, np.minimum(end[lo:hi] - first, len(part))
        out[lo:hi] = (total[z] - total[a]) * back[a] + (z - a).astype(np.uint64)
    out = _mix(out)
    for i in np.nonzero(end - start > LONG_WORD)[0].tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]].tobytes())
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, by differences of one running sum."""
    rows = len(w) - n + 1
    if rows <= 0:
        return np.zeros(0, np.uint64)
    power, back = _powers(len(w))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * power[:len(w)], out=total[1:])
    return _mix((total[n:] - total[:rows]) * back[:rows])


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def whole_windows(lengths: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that lie inside one of the neighbouring texts."""
    end = np.cumsum(lengths)
    return ragged(end - lengths, np.maximum(lengths - size + 1, 0))


class Block:
    """The documents of a block, by id and text, whatever order they came in."""

    def __init__(self, table: pa.Table, size: int = SIZE):
        ids, raw = table.column("_id").to_numpy(), table.column("_raw").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        self.size = size
        self.ids = ids[order]
        self.texts = [raw[i] for i in order]
        self.buf = np.frombuffer(b"\n".join(self.texts), np.uint8)
        self.start, self.stop = word_edges(self.buf)
        text_end = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(raw)) + 1)
        self.ends = np.searchsorted(self.start, text_end)  # in words
        self.lengths = np.diff(self.ends, prepend=0)
        self.w = word_hashes(self.buf, self.start, self.stop)
        self.at = whole_windows(self.lengths, size)  # every window's first word
        low = _lowest(run_hashes(self.w, GRAM), size - GRAM + 1) if len(self.w) >= size else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        low = low[self.at]
        new = np.ones(len(low), bool)  # runs of windows with one anchor in one document
        new[1:] = (low[1:] != low[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.run = np.nonzero(new)[0]
        self.run_size = np.diff(np.append(self.run, len(low)))
        self.anchors, self.first, self.anchor = np.unique(low[self.run], return_index=True, return_inverse=True)

    def least(self) -> np.ndarray:
        """The smallest id that has each anchor: documents are in order of id."""
        return self.ids[self.doc[self.run[self.first]]]

    def several(self) -> np.ndarray:
        """Anchors that documents of different ids in this block have."""
        top = np.full(len(self.anchors), -1, self.ids.dtype)
        np.maximum.at(top, self.anchor, self.ids[self.doc[self.run]])
        return top != self.least()

    def by_bucket(self, hashes: np.ndarray, buckets: int):
        """(bucket, indices of the hashes that fall into it), in order."""
        bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.nonzero(np.diff(bucket[order]))[0] + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(bucket[part[0]]), part

    def stretch(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, document) around the first run of each anchor."""
        run = self.first[anchors]
        lo = self.at[self.run[run]]
        return lo, lo + self.run_size[run] - 1 + self.size, self.doc[self.run[run]]

    def parse(self, shared: np.ndarray, references: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Factor the documents against the references and each other.

        ``gone``: words of the factors. ``open``: windows of shared anchors
        outside all factors, one of each hash, with their hashes and ids.
        """
        size = self.size
        mine = ragged(self.run[shared[self.anchor]], self.run_size[shared[self.anchor]])  # windows with a shared anchor
        n = len(self.w)
        seg_w = np.concatenate([self.w, *(r[2] for r in references)])
        seg_len = np.concatenate([self.lengths, *(r[1] for r in references)]).astype(np.int64)
        seg_id = np.concatenate([self.ids, *(r[0] for r in references)])
        seg_end = np.cumsum(seg_len)
        hashes = run_hashes(seg_w, size)
        theirs = whole_windows(seg_len[len(self.ids):], size) + n
        spot = np.concatenate([self.at[mine], theirs])
        owner = seg_id[np.searchsorted(seg_end, spot, side="right")]
        h = hashes[spot] if len(spot) else np.zeros(0, np.uint64)
        order = np.lexsort((spot, owner, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        best = np.empty(len(order), np.int64)  # the index: each hash's window in the smallest document
        best[order] = order[new][np.cumsum(new) - 1]
        own = np.arange(len(mine))
        hit = owner[best[own]] < owner[own]
        mark = np.zeros(n + 1, np.int64)
        start, source = spot[own[hit]].tolist(), spot[best[own[hit]]].tolist()
        stop = self.ends[self.doc[mine[hit]]].tolist()
        source_stop = seg_end[np.searchsorted(seg_end, spot[best[own[hit]]], side="right")].tolist()
        k = 0
        while k < len(start):
            i, end = start[k], stop[k]
            length = _match(seg_w, i, end, source[k], source_stop[k])
            if length < size:  # a hash that two windows share
                k += 1
                continue
            mark[i] += 1
            mark[i + length] -= 1
            # the next window that crosses the factor's end, or comes behind it
            k = bisect_left(start, i + length - size + 1, k + 1)
        self.gone = np.cumsum(mark[:n]) > 0
        rest = mine[~hit]
        self.open_at, self.open_id = self.at[rest], self.ids[self.doc[rest]]
        self.open, first, self.open_of = np.unique(h[:len(mine)][~hit], return_index=True, return_inverse=True)
        self.open_least = self.open_id[first]

    def close(self, smaller: np.ndarray) -> None:
        """Take in which of the open hashes a smaller document has."""
        mark = np.zeros(len(self.w) + 1, np.int64)
        at = self.open_at[smaller[self.open_of]]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + self.size, -1)
        self.gone |= np.cumsum(mark[:-1]) > 0


def _match(w: np.ndarray, i: int, end: int, j: int, stop: int) -> int:
    """How many words from i and j on are equal."""
    most, done, step = min(end - i, stop - j), 0, 64
    while done < most:
        z = min(done + step, most)
        differ = w[i + done:i + z] != w[j + done:j + z]
        if differ.any():
            return done + int(differ.argmax())
        done, step = z, step * 2
    return most


# ------------------------------------------------------------------ Spark jobs
_TO_BUCKET = "block bigint, bucket bigint, hashes binary, ids binary, several binary"
# kind 0: bits of anchors, 1: references, 2: bits of windows, 3: anchors to send to peers
_TO_BLOCK = "block bigint, kind int, bucket bigint, data binary, more binary, text binary"
_BUCKET_ROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()),
                         ("several", pa.binary())])
_BLOCK_ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary()),
                        ("more", pa.binary()), ("text", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _join(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _send_anchors(buckets: int, size: int):
    def send(table: pa.Table) -> pa.Table:
        own, block = Block(table, size), table.column("block")[0].as_py()
        least, several = own.least(), own.several()
        return _rows([(block, bucket, (own.anchors[part] & _LOW40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                       least[part].astype("<i8").tobytes(), np.packbits(several[part]).tobytes())
                      for bucket, part in own.by_bucket(own.anchors, buckets)], _BUCKET_ROW)

    return send


def _answer_anchors(fan: int):
    def answer(table: pa.Table) -> pa.Table:
        """Which anchors are shared, and whom each block shall ask for them."""
        blobs = table.column("hashes").to_pylist()
        sizes = np.array([len(b) // 5 for b in blobs])
        key = np.zeros((sizes.sum(), 8), np.uint8)
        key[:, :5] = _join(blobs, np.uint8).reshape(-1, 5)
        key = key.view("<u8").ravel()
        ids = _join(table.column("ids").to_pylist(), "<i8")
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n)
                                  for s, n in zip(table.column("several").to_pylist(), sizes)]).astype(bool)
        blocks, bucket = table.column("block").to_numpy(), table.column("bucket")[0].as_py()
        block, place = np.repeat(blocks, sizes), ragged(np.zeros(len(sizes), np.int64), sizes)
        order = np.lexsort((block, ids, key))
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        head = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        many = np.logical_or.reduceat(several[order], head) | (np.diff(np.append(head, len(k))) > 1)
        shared = np.empty(len(k), bool)
        shared[order] = many[group]
        rows = [(int(b), 0, bucket, np.packbits(p).tobytes(), None, None)
                for b, p in zip(blocks, np.split(shared, np.cumsum(sizes)[:-1]))]
        # holder number j of an anchor asks holder (j - 1) // fan, whose document is smaller
        rank = np.arange(len(k)) - head[group]
        child = np.nonzero(rank)[0]
        parent = order[head[group[child]] + (rank[child] - 1) // fan]
        child = order[child]
        by = np.argsort(block[parent], kind="stable")
        parent, child = parent[by], child[by]
        for part in np.split(np.arange(len(by)), np.nonzero(np.diff(block[parent]))[0] + 1):
            if len(part):
                rows.append((int(block[parent[part[0]]]), 3, bucket, place[parent[part]].astype("<u4").tobytes(),
                             block[child[part]].astype("<i8").tobytes(), None))
        return _rows(rows, _BLOCK_ROW)

    return answer


def _send_references(buckets: int, size: int):
    def send(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The stretches around the asked anchors, a row for each asking block."""
        if not docs.num_rows or not asked.num_rows:
            return _rows([], _BLOCK_ROW)
        own = Block(docs, size)
        part_of = dict(own.by_bucket(own.anchors, buckets))
        asked = asked.sort_by("bucket")
        anchor = np.concatenate([part_of[b][np.frombuffer(d, "<u4")] for b, d in
                                 zip(asked.column("bucket").to_pylist(), asked.column("data").to_pylist())])
        peer = _join(asked.column("more").to_pylist(), "<i8")
        lo, hi, doc = own.stretch(anchor)
        order = np.lexsort((lo, peer))
        lo, hi, doc, peer = lo[order], hi[order], doc[order], peer[order]
        # within a peer and document starts and ends ascend together: a stretch ends where the next one starts behind it
        new = np.ones(len(lo), bool)
        new[1:] = (peer[1:] != peer[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
        first = np.nonzero(new)[0]
        lo, hi, doc, peer = lo[first], hi[np.append(first[1:], len(hi)) - 1], doc[first], peer[first]
        rows = []
        for p in np.split(np.arange(len(lo)), np.nonzero(np.diff(peer))[0] + 1):
            text = b" ".join([own.buf[a:z].tobytes() for a, z in zip(own.start[lo[p]].tolist(), own.stop[hi[p] - 1].tolist())])
            rows.append((int(peer[p[0]]), 1, None, own.ids[doc[p]].astype("<i8").tobytes(),
                         (hi[p] - lo[p]).astype("<i8").tobytes(), text))
        return _rows(rows, _BLOCK_ROW)

    return send


def _parsed(docs: pa.Table, told: pa.Table, buckets: int, size: int) -> Block:
    """The block, parsed against the references it was sent."""
    own = Block(docs, size)
    bits, references = {}, []
    for r in told.to_pylist():
        if r["kind"] == 0:
            bits[r["bucket"]] = r["data"]
        elif r["kind"] == 1:
            text = np.frombuffer(r["text"], np.uint8)
            references.append((np.frombuffer(r["data"], "<i8"), np.frombuffer(r["more"], "<i8"), word_hashes(text, *word_edges(text))))
    shared = np.zeros(len(own.anchors), bool)
    for bucket, part in own.by_bucket(own.anchors, buckets):
        shared[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(part)).astype(bool)
    own.parse(shared, references)
    return own


def _send_open(buckets: int, size: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([], _BUCKET_ROW)
        own, block = _parsed(docs, told, buckets, size), docs.column("block")[0].as_py()
        return _rows([(block, bucket, own.open[part].astype("<u8").tobytes(), own.open_least[part].astype("<i8").tobytes(), None)
                      for bucket, part in own.by_bucket(own.open, buckets)], _BUCKET_ROW)

    return send


def _answer_open(table: pa.Table) -> pa.Table:
    """Does a smaller document have the window?"""
    blobs = table.column("hashes").to_pylist()
    h, ids = _join(blobs, "<u8"), _join(table.column("ids").to_pylist(), "<i8")
    _, inverse = np.unique(h, return_inverse=True)
    least = np.full(inverse.max() + 1 if len(h) else 0, NO_ID)
    np.minimum.at(least, inverse, ids)
    parts = np.split(least[inverse] < ids, np.cumsum([len(b) // 8 for b in blobs])[:-1])
    return _rows([(b, 2, k, np.packbits(p).tobytes(), None, None) for b, k, p in
                  zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), parts)], _BLOCK_ROW)


def remove_passages(docs: DataFrame, finish: Callable[[list, list[bytes], list[np.ndarray]], dict], schema: str,
                    id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Map every document's bytes and the mask of its removed words by
    ``finish(ids, texts, masks) -> columns`` (a null id as None), block by block."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    named = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"),
                        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block"))
    dealt = named.repartition(parts, "block")  # the one shuffle of the texts; its readers share it
    told = (dealt.groupBy("block").applyInArrow(_send_anchors(blocks, size), _TO_BUCKET)
            .groupBy("bucket").applyInArrow(_answer_anchors(fan), _TO_BLOCK))
    asked = told.where("kind = 3")
    references = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_send_references(blocks, size), _TO_BLOCK)
    known = told.where("kind = 0").unionByName(references)
    left = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_open(blocks, size), _TO_BUCKET)
    every = known.unionByName(left.groupBy("bucket").applyInArrow(_answer_open, _TO_BLOCK))
    names = [f.split()[0] for f in schema.split(", ")]

    def last(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            cols = finish([], [], [])
        else:
            own = _parsed(table, told, blocks, size)
            bits = {r["bucket"]: r["data"] for r in told.to_pylist() if r["kind"] == 2}
            smaller = np.zeros(len(own.open), bool)
            for bucket, part in own.by_bucket(own.open, blocks):
                smaller[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(part)).astype(bool)
            own.close(smaller)
            cols = finish([None if i == NO_ID else int(i) for i in own.ids], own.texts, np.split(own.gone, own.ends[:-1]))
        return pa.table({n: cols[n] for n in names})

    return dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(last, schema)


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words, ends exclusive."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def kept_words(text: bytes, mask: np.ndarray) -> bytes:
    words = text.split()  # bytes: splits at \x20 and \x09-\x0D
    return b" ".join(compress(words, (~mask).tolist()) if mask.any() else words)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, spans, kept): the operator's own output, word ranges and the kept words."""

    def finish(ids, texts, masks):
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(m) for m in masks], pa.int64()),
                "spans": pa.array([[{"start": a, "stop": z} for a, z in spans_of(m)] for m in masks], spans),
                "kept": pa.array([kept_words(t, m).decode("utf-8", "replace") for t, m in zip(texts, masks)], pa.string())}

    return remove_passages(docs, finish, "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, "
                                         "kept string", id_col, text_col, **options)


def digest(ids, texts, masks) -> dict:
    """The digest columns of the query."""
    return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(m) for m in masks], pa.int64()),
            "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_words(t, m)).hexdigest() for t, m in zip(texts, masks)], pa.string())}


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"

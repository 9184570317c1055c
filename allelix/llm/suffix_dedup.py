"""Exact substring deduplication by blockwise suffix sorting (operator 3).

A byte goes if it is covered by a string of ``size`` bytes that also starts in
a document with a smaller id. Matches never cross documents.

Sorting all suffixes of a corpus at once would move every byte many times, so
suffixes are sorted one bucket at a time, and only those that can repeat:

1. Cover sample. Of each window of ``size`` bytes, the position whose ``GRAM`` bytes
   hash lowest (the leftmost on ties) is in the sample. Like a difference
   cover it gives any two equal windows a sample position at the same shift, but the sample is
   chosen by content: about one position in 16, where a cover modulo 31 takes
   6 in 31 (see the README for the figures). Each window belongs to one sample
   position, its anchor.
2. Pruning. Documents are dealt into blocks; each block sends its distinct anchor
   hashes (5 bytes each) to hash buckets and gets back one bit for each:
   does another document have it? Windows of unshared anchors can't repeat.
3. Suffix buckets. For every distinct context of a shared anchor a block sends
   the context's bytes and the smallest id that has it. A bucket holds all suffixes whose anchor
   hashes fall into it and is sorted alone, in bounded memory: first the
   sample suffixes at every ``STEP`` bytes are ranked, with their longest common prefixes; a suffix is
   then ordered by its first ``d < STEP`` bytes and the rank of the sample suffix
   at shift d, which settles ties of any length without comparing further.
   Groups of suffixes equal in ``size`` bytes give the smallest id, and the block gets back one
   bit per suffix: does a smaller document have it?
4. Each block marks the covered bytes of its own documents.

A passage that a third of all documents share enters a bucket once per block
and context, not once per document. Every step is a function of the rows, so a lost
executor's part is computed again to the same result.

A null text is empty; shorter texts keep all bytes. A null id counts as larger
than every other; rows that repeat an id are one document and don't
remove each other's bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 50
GRAM = 20
STEP = 8
BLOCK_BYTES = 4_000_000
CACHE_BYTES = 128_000
NO_ID = 2**63 - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_LOW40 = np.uint64(2**40 - 1)


# ------------------------------------------------------------ the cover sample
def _words_at(buf: bytes, n: int, shift: int) -> np.ndarray:
    """The 8 bytes from every position on, as numbers; ``buf`` has room behind n."""
    return np.ndarray((n,), "<u8", buf, offset=shift, strides=(1,))


def gram_hashes(buf: bytes, n: int) -> np.ndarray:
    """Hash of the GRAM bytes from each of the first n positions."""
    h = _words_at(buf, n, 0) * _M[0]
    h += _words_at(buf, n, 8) * _M[1]
    h += _words_at(buf, n, GRAM - 8) * _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[3]
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def anchors(buf: bytes, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, at, hash): the windows starting at lo..hi belong to the anchor at ``at``.

    ``buf`` is texts one behind the other (with spare bytes), ``ends`` their
    ends; windows that would cross an end are left out.
    """
    n = int(ends[-1]) if len(ends) else 0
    empty = np.zeros(0, np.int64)
    if n < size:
        return empty, empty, empty, empty.astype(np.uint64)
    grams = size - GRAM + 1
    h = gram_hashes(buf, n - GRAM + 1)
    low = _sliding_min(h, grams)  # of the windows 0 .. n - size
    whole = np.zeros(len(low) + 1, np.int8)
    start = np.concatenate([[0], ends[:-1]])
    ok = ends - start >= size
    np.add.at(whole, start[ok], 1)
    np.add.at(whole, ends[ok] - size + 1, -1)
    whole = np.cumsum(whole[:-1]).astype(bool)
    # runs of windows with one minimum
    new = whole.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
    lo = np.nonzero(new)[0]
    last = whole.copy()
    last[:-1] &= new[1:] | ~whole[1:]
    hi = np.nonzero(last)[0]
    out_lo, out_hi, out_at = [], [], []
    for turn in range(4):
        at = np.full(len(lo), -1)
        left = np.arange(len(lo))
        if not turn:
            # where a lower hash came in, it stands in the window's last place
            came = (lo > 0) & whole[lo - 1] & (low[lo] < low[lo - 1])
            at[came] = lo[came] + grams - 1
            left = left[~came]
        for j in range(grams):  # the leftmost place of the minimum
            found = h[lo[left] + j] == low[lo[left]]
            at[left[found]] = lo[left[found]] + j
            left = left[~found]
            if not len(left):
                break
        stop = np.minimum(hi, at)  # beyond its place the run goes on with the next equal hash
        out_lo.append(lo), out_hi.append(stop), out_at.append(at)
        more = hi > at
        if not more.any():
            break
        lo, hi = at[more] + 1, hi[more]
        if turn == 2:  # periodic text: every window by itself
            count = hi - lo + 1
            lo = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hi = lo
    lo, hi, at = (np.concatenate(x).astype(np.int64) for x in (out_lo, out_hi, out_at))
    order = np.argsort(lo, kind="stable")
    lo, hi, at = lo[order], hi[order], at[order]
    return lo, hi, at, h[at]


# ------------------------------------------------------------------ one block
class Block:
    """The documents of a block, in an order that doesn't depend on how they came."""

    def __init__(self, table: pa.Table):
        ids = table.column("_id").to_numpy()
        raw = table.column("_raw").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        self.ids = ids[order]
        self.raw = [raw[i] for i in order]
        self.buf = b"".join(self.raw) + bytes(128)
        self.ends = np.cumsum([len(r) for r in self.raw])
        self.lo, self.hi, self.at, self.h = self._anchors()
        self.doc = np.searchsorted(self.ends, self.lo, side="right")
        self.distinct, self.inverse = np.unique(self.h, return_inverse=True)

    def _anchors(self):
        """Anchors of the whole block, some documents at a time: their arrays fit a processor's cache."""
        parts, first, start = [], 0, 0
        for k, end in enumerate(self.ends.tolist()):
            if end - start >= CACHE_BYTES or k + 1 == len(self.ends):
                lo, hi, at, h = anchors(self.buf[start:end + 128], self.ends[first:k + 1] - start)
                parts.append((lo + start, hi + start, at + start, h))
                first, start = k + 1, end
        return [np.concatenate(x) for x in zip(*parts)]

    def bucket_rows(self, buckets: int):
        """(bucket, distinct hashes that fall into it) - as index arrays, by bucket."""
        bucket = (self.distinct >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.nonzero(np.diff(bucket[order]))[0] + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(bucket[part[0]]), part

    def several(self) -> np.ndarray:
        """Hashes that more than one document of the block has."""
        lo = np.full(len(self.distinct), len(self.raw))
        hi = np.full(len(self.distinct), -1)
        np.minimum.at(lo, self.inverse, self.doc)
        np.maximum.at(hi, self.inverse, self.doc)
        return lo != hi

    def share(self, buckets: int, bits: dict[int, bytes]) -> None:
        """Take in the buckets' answers: occurrences of shared anchors, and their distinct contexts."""
        shared = np.zeros(len(self.distinct), bool)
        for bucket, part in self.bucket_rows(buckets):
            shared[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(part)).astype(bool)
        use = shared[self.inverse]
        self.o_lo, self.o_hi, self.o_at, self.o_h, self.o_doc = (
            x[use] for x in (self.lo, self.hi, self.at, self.h, self.doc))
        key = np.empty(len(self.o_lo), np.uint64)
        for c in _chunks(len(key)):
            key[c] = self._context_key(c)
        _, self.first, self.entry = np.unique(key, return_index=True, return_inverse=True)
        if not all(np.array_equal(self._named(c), self._named(self.first[self.entry[c]])) for c in _chunks(len(key))):
            # two contexts with one hash: told apart by their bytes
            names = np.concatenate([self._named(c) for c in _chunks(len(key))])
            _, self.first, self.entry = np.unique(as_one(names), return_index=True, return_inverse=True)
        self.least = np.full(len(self.first), NO_ID)
        np.minimum.at(self.least, self.entry, self.ids[self.o_doc])

    def text_of(self, o) -> np.ndarray:
        """The contexts of some occurrences, as rows."""
        return context_rows(self.buf, self.o_lo[o], self.o_hi[o] - self.o_lo[o] + SIZE)

    def _context_key(self, o) -> np.ndarray:
        wide, left = self.o_hi[o] - self.o_lo[o] + SIZE, self.o_at[o] - self.o_lo[o]
        return row_hash(self.text_of(o), wide.astype(np.uint64), left.astype(np.uint64)) ^ self.o_h[o]

    def _named(self, o) -> np.ndarray:
        """Anchor hash, length, place and bytes: equal rows are equal contexts."""
        wide, left = self.o_hi[o] - self.o_lo[o] + SIZE, self.o_at[o] - self.o_lo[o]
        return named_rows(self.o_h[o], wide, left, self.text_of(o))

    def contexts(self, buckets: int):
        """(bucket, entries) by bucket."""
        h = self.o_h[self.first]
        bucket = (h >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.nonzero(np.diff(bucket[order]))[0] + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(bucket[part[0]]), part

    def covered(self, buckets: int, bits: dict[int, bytes]) -> np.ndarray:
        """Which bytes go: the buckets' bits say which windows a smaller document has."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        count = self.o_hi[self.first] - self.o_lo[self.first] + 1
        offset = np.concatenate([[0], np.cumsum(count)])
        smaller = np.zeros(offset[-1], bool)
        for bucket, part in self.contexts(buckets):
            size = count[part]
            flat = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=size.sum()).astype(bool)
            smaller[ragged(offset[part], size)] = flat
        mark = np.zeros(n + 1, np.int64)
        size = self.o_hi - self.o_lo + 1
        where = ragged(offset[self.entry], size)
        gone = smaller[where] | np.repeat(self.ids[self.o_doc] > self.least[self.entry], size)
        at = ragged(self.o_lo, size)[gone]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + SIZE, -1)
        return np.cumsum(mark[:n]) > 0


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


_ROW = 2 * SIZE - GRAM  # no context is longer than this: 80 bytes


_CHUNK_ROWS = 1 << 15


def _chunks(n: int) -> list[slice]:
    return [slice(k, min(k + _CHUNK_ROWS, n)) for k in range(0, n, _CHUNK_ROWS)]


def context_rows(buf: bytes, lo: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The contexts as rows of _ROW bytes, zeros behind them; ``buf`` has _ROW spare bytes."""
    if not len(lo):
        return np.zeros((0, _ROW), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buf, np.uint8), _ROW)[lo]
    rows[np.arange(_ROW) >= wide[:, None]] = 0
    return rows


def named_rows(h: np.ndarray, wide: np.ndarray, left: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), 16 + _ROW), np.uint8)
    out[:, :8] = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    out[:, 8], out[:, 9] = wide, left
    out[:, 16:] = rows
    return out


def as_one(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as one value each."""
    return np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()


def row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(rows), np.uint64)
    words = np.ascontiguousarray(rows).view("<u8")
    for w in [words[:, k] for k in range(words.shape[1])] + list(more):
        acc = (acc ^ w) * _M[0]
        acc ^= acc >> np.uint64(29)
        acc *= _M[3]
        acc ^= acc >> np.uint64(32)
    return acc


# --------------------------------------------------------------- a suffix bucket
def smallest_ids(h: np.ndarray, left: np.ndarray, count: np.ndarray, rows: np.ndarray,
                 least: np.ndarray) -> np.ndarray:
    """For each window of each context, in order: has a context of the bucket
    with a smaller id the same window?

    ``left``: bytes before the anchor in the context; ``count``: its windows.
    Coordinates are relative to the anchor: equal windows start at equal ones.
    """
    n = len(h)
    offset = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(offset[-1], bool)
    if not n:
        return out
    # contexts that several blocks sent are sorted once
    key = row_hash(rows, left.astype(np.uint64), count.astype(np.uint64)) ^ h
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    if len(first) < n:
        names = named_rows(h, count, left, rows)
        if not np.array_equal(names, names[first[same]]):  # two contexts with one hash
            _, first, same = np.unique(as_one(names), return_index=True, return_inverse=True)
        del names
    low = np.full(len(first), NO_ID)
    np.minimum.at(low, same, least)
    h1, left1, count1, rows1 = h[first], left[first], count[first], rows[first]
    offset1 = np.concatenate([[0], np.cumsum(count1)])
    best = np.empty(offset1[-1], np.int64)
    padded = np.concatenate([rows1, np.zeros((len(rows1), SIZE + STEP), np.uint8)], axis=1)
    width, from_byte = padded.shape[1], np.lib.stride_tricks.sliding_window_view(padded.ravel(), SIZE + 6)
    top = int(left1.max())
    for sample in range(0, top + 1, STEP):  # sample suffixes `sample` bytes before the anchor, 0 first
        users = [x for x in range(sample, min(sample + STEP - 1, top) + 1)]
        have = np.nonzero((left1 >= users[0]) & (left1 - count1 < users[-1]))[0]
        if not len(have):
            continue
        # rank the sample suffixes; those of contexts that begin behind it are never asked for
        at = np.maximum(left1[have] - sample, 0)
        suffix = from_byte[have * width + at]
        words = suffix.view(">u8").astype(np.uint64)
        order = np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), h1[have]])
        suffix = suffix[order]
        differ = suffix[:-1] != suffix[1:]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), suffix.shape[1])
        lcp[h1[have][order[:-1]] != h1[have][order[1:]]] = 0
        for x in users:  # windows that start x bytes before the anchor, d before the sample
            d = x - sample
            here = (left1[have] >= x) & (left1[have] - count1[have] < x)
            if not here.any():
                continue
            name = np.empty(len(have), np.int64)  # equal names: equal in SIZE - d bytes from the sample on
            name[order] = np.concatenate([[0], np.cumsum(lcp < SIZE - d)])
            mine = have[here]
            head = np.zeros(len(mine), np.uint64)
            for k in range(d):
                head = head << np.uint64(8) | rows1[mine, left1[mine] - x + k].astype(np.uint64)
            sort = np.lexsort([low[mine], name[here], head])
            g_head, g_name = head[sort], name[here][sort]
            start = np.ones(len(sort), bool)
            start[1:] = (g_head[1:] != g_head[:-1]) | (g_name[1:] != g_name[:-1])
            lead = np.maximum.accumulate(np.where(start, np.arange(len(sort)), 0))
            # windows of a context are in order of their start: left - x of them come before
            best[offset1[mine[sort]] + left1[mine[sort]] - x] = low[mine[sort]][lead]
    got = best[ragged(offset1[same], count)]
    return got < np.repeat(least, count)


# ------------------------------------------------------------------ Spark jobs
_BITS = "block bigint, kind int, bucket bigint, bits binary"


def _bits_table(block, kind, bucket, bits) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array(np.full(len(block), kind), pa.int32()),
                     "bucket": pa.array(bucket, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _send_anchors(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        own = Block(table)
        several = own.several()
        block = table.column("block")[0].as_py()
        rows = []
        for bucket, part in own.bucket_rows(buckets):
            low = (own.distinct[part] & _LOW40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((block, bucket, low.tobytes(), np.packbits(several[part]).tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()),
                         "hashes": pa.array(cols[2], pa.binary()), "several": pa.array(cols[3], pa.binary())})

    return send


def _answer_anchors(table: pa.Table) -> pa.Table:
    blobs, several = table.column("hashes").to_pylist(), table.column("several").to_pylist()
    sizes = np.array([len(b) // 5 for b in blobs])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    keys = wide.view("<u8").ravel()
    many = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(several, sizes)]).astype(bool)
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, inverse, many)
    parts = np.split(shared[inverse], np.cumsum(sizes)[:-1])
    return _bits_table(table.column("block").to_pylist(), 0, table.column("bucket").to_pylist(),
                       [np.packbits(p).tobytes() for p in parts])


def _bits_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in table.to_pylist() if r["kind"] == kind}


def _send_contexts(buckets: int):
    def send(docs: pa.Table, bits: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            own = Block(docs)
            own.share(buckets, _bits_of(bits, 0))
            block = docs.column("block")[0].as_py()
            for bucket, part in own.contexts(buckets):
                o = own.first[part]
                left, count = own.o_at[o] - own.o_lo[o], own.o_hi[o] - own.o_lo[o] + 1
                text = own.text_of(o)[np.arange(_ROW) < (count + SIZE - 1)[:, None]]
                rows.append((block, bucket, own.o_h[o].tobytes(), left.astype(np.uint8).tobytes(),
                             count.astype(np.uint8).tobytes(), text.tobytes(), own.least[part].astype("<i8").tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 7
        names = ["hashes", "lefts", "counts", "texts", "least"]
        return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64())}
                        | {n: pa.array(c, pa.binary()) for n, c in zip(names, cols[2:])})

    return send


def by_anchor(h: np.ndarray):
    """The places in h, some anchors at a time: all of an anchor together, about _CHUNK_ROWS of them."""
    order = np.argsort(h, kind="stable")
    new = np.nonzero(np.diff(h[order]))[0] + 1
    at = 0
    while at < len(h):
        k = np.searchsorted(new, at + _CHUNK_ROWS)
        stop = int(new[k]) if k < len(new) else len(h)
        yield order[at:stop]
        at = stop


def _answer_contexts(table: pa.Table) -> pa.Table:
    col = lambda name: b"".join(table.column(name).to_pylist())
    h = np.frombuffer(col("hashes"), np.uint64)
    left = np.frombuffer(col("lefts"), np.uint8).astype(np.int64)
    count = np.frombuffer(col("counts"), np.uint8).astype(np.int64)
    least = np.frombuffer(col("least"), "<i8")
    texts = col("texts") + bytes(_ROW)
    wide = count + SIZE - 1
    start, window = np.cumsum(wide) - wide, np.cumsum(count) - count
    smaller = np.zeros(int(count.sum()), bool)
    for some in by_anchor(h):
        smaller[ragged(window[some], count[some])] = smallest_ids(
            h[some], left[some], count[some], context_rows(texts, start[some], wide[some]), least[some])
    sizes = [len(b) // 8 for b in table.column("hashes").to_pylist()]
    windows = np.add.reduceat(count, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if sizes else []
    parts = np.split(smaller, np.cumsum(windows)[:-1])
    return _bits_table(table.column("block").to_pylist(), 1, table.column("bucket").to_pylist(),
                       [np.packbits(p).tobytes() for p in parts])


def remove_repeats(docs: DataFrame, finish: Callable[[list, list[bytes], list[np.ndarray]], dict], schema: str,
                   id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Map every document's bytes and the mask of its removed bytes by
    ``finish(ids, texts, masks) -> columns`` (a null id as None), block by block."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 4 * blocks))
    named = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"), raw.alias("_raw"),
                        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block"))
    # the one shuffle of the texts; its three readers share it
    dealt = named.repartition(parts, "block")
    sent = dealt.groupBy("block").applyInArrow(
        _send_anchors(blocks), "block bigint, bucket bigint, hashes binary, several binary")
    shared = sent.groupBy("bucket").applyInArrow(_answer_anchors, _BITS)
    contexts = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _send_contexts(blocks), "block bigint, bucket bigint, hashes binary, lefts binary, counts binary, "
                                "texts binary, least binary")
    smaller = contexts.groupBy("bucket").applyInArrow(_answer_contexts, _BITS)
    both = shared.unionByName(smaller)
    names = [f.split()[0] for f in schema.split(", ")]

    def last(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            cols = finish([], [], [])
        else:
            own = Block(table)
            own.share(blocks, _bits_of(bits, 0))
            gone = own.covered(blocks, _bits_of(bits, 1))
            masks = np.split(gone, own.ends[:-1])
            cols = finish([None if i == NO_ID else int(i) for i in own.ids], own.raw, masks)
        return pa.table({n: cols[n] for n in names})

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(last, schema)


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, ends exclusive."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the operator's own output, bytes and their removed ranges."""

    def finish(ids, texts, masks):
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "spans": pa.array([[{"start": a, "stop": z} for a, z in spans_of(m)] for m in masks], spans),
                "kept": pa.array([np.frombuffer(t, np.uint8)[~m].tobytes() for t, m in zip(texts, masks)], pa.binary())}

    return remove_repeats(docs, finish, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, "
                                        "kept binary", id_col, text_col)


def digest(ids, texts, masks) -> dict:
    """The digest columns of the query."""
    kept = [np.frombuffer(t, np.uint8)[~m].tobytes() if m.any() else t for t, m in zip(texts, masks)]
    return {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
            "n_spans": pa.array([len(spans_of(m)) for m in masks], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

"""Line deduplication by range-partitioned, secondarily sorted line hashes (operator 4).

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with
A-Z lower-cased; only keys of at least ``min_chars`` code points count. A key
found in two documents or more stays only in the smallest id that holds it.

1. Each task splits its texts and hashes the keys (128 bits). Of the
   documents it has seen with a key, only the smallest id competes further;
   all others have already lost that line. So a line that a third of all
   documents share enters the shuffle about once per task, not once per
   document.
2. Competitors are dealt out by ranges of the uniform hash (the range is
   computed from the hash, so no sampling pass) and sorted by hash, document
   and position; a streaming pass keeps the first document of each run and
   reports the rest as dropped.
3. Drops are gathered per document into a compressed keep bitmap. Texts are
   not part of any of these shuffles.

Rows with one id are one document: they don't drop each other's lines. A null
id counts as larger than every other. A null text is one empty line. Rows
that repeat both id and text have the same bitmap, one row for each distinct
(id, text) pair. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
NO_ID = 2**63 - 1
# keys that a task remembers before it passes its competitors on
HELD_KEYS = 400_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, _text): a row's identity is its id and the hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(text).alias("_th"), text.alias("_text"))


def line_key(line: str) -> bytes:
    """Stripped, A-Z lower-cased (bytes.lower changes ASCII letters only)."""
    return line.strip(STRIP).encode("utf-8", "surrogatepass").lower()


_LINES = pa.schema([("part", pa.int32()), ("lost", pa.bool_()), ("hi", pa.int64()), ("lo", pa.int64()),
                    ("_id", pa.int64()), ("_th", pa.int64()), ("at", pa.binary())])
_DROPS = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("at", pa.binary())])


def _hash_lines(parts: int, min_chars: int):
    """Batches of texts -> one row per (document, key): lost, or a competitor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}  # key -> [smallest id, [(th, positions), ...]]
        out: list[list] = [[] for _ in _LINES]
        turn = 0

        def put(lost, key, doc, th, at):
            nonlocal turn
            hi = int.from_bytes(key[:8], "big")
            turn += 1
            # a competitor goes to its hash range; a lost row only passes through, anywhere
            values = (turn % parts if lost else hi * parts >> 64, lost, hi - 2**63,
                      int.from_bytes(key[8:], "big") - 2**63, doc, th, np.array(at, "<u4").tobytes())
            for col, v in zip(out, values):
                col.append(v)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LINES)], schema=_LINES)
            for col in out:
                col.clear()
            return batch

        def let_go():
            for key, (doc, own) in held.items():
                for th, at in own:
                    put(False, key, doc, th, at)
            held.clear()

        for batch in batches:
            for doc, th, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "_text"))):
                own: dict[bytes, list] = {}
                for i, line in enumerate(text.split("\n")):
                    line = line.strip(STRIP)
                    if len(line) >= min_chars:
                        key = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower())
                        if key in own:
                            own[key].append(i)
                        else:
                            own[key] = [i]
                for key, at in own.items():
                    best = held.get(key)
                    if best is None:
                        held[key] = [doc, [(th, at)]]
                    elif doc > best[0]:
                        put(True, key, doc, th, at)
                    elif doc == best[0]:
                        if (th, at) not in best[1]:
                            best[1].append((th, at))
                    else:
                        for th0, at0 in best[1]:
                            put(True, key, best[0], th0, at0)
                        held[key] = [doc, [(th, at)]]
                if len(held) >= HELD_KEYS:
                    let_go()
                if len(out[0]) >= 50_000:
                    yield flush()
        let_go()
        for_all = len(out[0])
        if for_all:
            yield flush()

    return rows


def _stream_drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> rows to drop: all of a hash's run but those of its first document."""
    last = None  # (hi, lo) of the run so far and its first document
    keeper = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "_id"))
        lost = batch.column("lost").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (lost[1:] != lost[:-1])
        if last == (hi[0], lo[0], lost[0]):
            new[0] = False
        run = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(run >= 0, doc[run], keeper if keeper is not None else 0)
        drop = lost | (doc != first)
        last, keeper = (hi[-1], lo[-1], lost[-1]), first[-1]
        yield batch.select(["_id", "_th", "at"]).filter(pa.array(drop))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
          parts: int | None = None) -> DataFrame:
    """(_id, _th, at): little-endian uint32 positions of lines to drop, some rows per document."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _keyed(docs, id_col, text_col).mapInArrow(
        _hash_lines(n, min_chars),
        "part int, lost boolean, hi bigint, lo bigint, _id bigint, _th bigint, at binary")
    dealt = lines.repartitionById(n, F.col("part")).sortWithinPartitions("lost", "hi", "lo", "_id", "_th", "at")
    return dealt.drop("part").mapInArrow(_stream_drops, "_id bigint, _th bigint, at binary")


def pack_bitmap(n_lines: int, positions: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, n_lines, n_dropped, keep_bitmap) for every distinct (id, text).

    ``keep_bitmap`` is a zlib-compressed bit per line, first line in the
    highest bit; null where every line stays.
    """
    gone = _gathered(drops(docs, id_col, text_col, min_chars))
    size = (_keyed(docs, id_col, text_col)
            .select("_id", "_th", (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1)
                    .cast("bigint").alias("n_lines")).distinct())
    schema = "_id bigint, _th bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary"
    marked = size.join(gone, ["_id", "_th"], "left").mapInArrow(_bitmaps, schema)
    return marked.select(_id_out().alias(id_col), F.col("_th").alias("text_hash"),
                         "n_lines", "n_dropped", "keep_bitmap")


def _id_out() -> Column:
    return F.when(F.col("_id") != NO_ID, F.col("_id"))


def _gathered(gone: DataFrame) -> DataFrame:
    # a document's drops are bounded by its own lines
    return gone.groupBy("_id", "_th").agg(F.collect_list("at").alias("at"))


def _positions(at: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(at or ()), "<u4"))


def _bitmaps(batches):
    for b in batches:
        pos = [_positions(at) for at in b.column("at").to_pylist()]
        maps = [pack_bitmap(n, p) if len(p) else None for n, p in zip(b.column("n_lines").to_pylist(), pos)]
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_th"), b.column("n_lines"), pa.array([len(p) for p in pos], pa.int64()),
             pa.array(maps, pa.binary())], ["_id", "_th", "n_lines", "n_dropped", "keep_bitmap"])


def kept_text(text: str, bitmap: bytes | None) -> str:
    """The text without its dropped lines."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    return "\n".join(x for x, k in zip(lines, unpack_bitmap(bitmap, len(lines))) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, fn, schema: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Join every document with its bitmap and map the batches
    (_id, _text, n_lines, n_dropped, keep_bitmap) by ``fn``."""
    keyed = _keyed(docs, id_col, text_col)
    maps = bitmaps.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_th"),
                          "n_lines", "n_dropped", "keep_bitmap")
    return keyed.join(maps, ["_id", "_th"]).drop("_th").mapInArrow(fn, schema)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest columns of the query."""
    for b in batches:
        sha = [hashlib.sha256(kept_text(t, m).encode("utf-8", "surrogatepass")).hexdigest()
               for t, m in zip(b.column("_text").to_pylist(), b.column("keep_bitmap").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_lines"), b.column("n_dropped"),
                                          pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


DIGEST = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"

"""Token ids in directly addressable codes (operator 8).

An id is split into chunks of ``width`` bits, lowest first. Level 0 holds the
lowest chunk of every id and one bit per id: does it go on? Level k holds the
k-th chunk of those ids that reach it. A rank directory (ones before every
512 bits) finds the place of id i in the next level: ``rank1(bitmap, i)``. So
``Shard.token(i)`` reads any id without decoding a block, and ids of less
than ``2**width`` cost one chunk and one bit.

A file of the format is a Parquet data set in the shared folder, written by
Spark's own committer (a lost executor's task is run again, half-written
files are never seen). Each row is a shard: documents in ascending id order,
their first positions, the levels, and the shard's place among its part's
ids. Parts are ranges of the document id, so a document's first position in
the corpus is its part's offset plus its place; the offsets are a table with
one row per part.

Every document ends with ``end_id``; a null or empty text is the end id
alone. Null ids come last; rows that repeat an id stay apart, in the order of
their texts. An empty table writes a data set without rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.session import checkpoint_dir

from .shingles import release

WIDTH = 8
END_ID = 2
SHARD_TOKENS = 1_000_000
RANK_BITS = 512
# pieces whose ids a Python worker keeps (some 35 bytes each), the longest of them in bytes, pieces encoded in
# one call of the library (its answer takes some 500 bytes a piece), characters of text encoded at a time
CACHE_PIECES = 600_000
KEPT_BYTES = 256
JOINED_PIECES = 20_000
BATCH_CHARS = 4_000_000


# ---------------------------------------------------------------- the format
class Shard:
    """Directly addressable codes of one array of ids."""

    def __init__(self, width: int, n: int, levels: list[tuple[bytes, bytes, bytes]]):
        self.width, self.n = width, n
        kind = np.uint8 if width <= 8 else np.uint16
        self.chunks = [np.frombuffer(c, kind) for c, _, _ in levels]
        self.bits = [np.frombuffer(b, np.uint8) for _, b, _ in levels]
        self.ranks = [np.frombuffer(r, "<u4") for _, _, r in levels]

    def token(self, i: int) -> int:
        """Id i, by one bit test and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (k * self.width)
            if not self.bits[k][i >> 3] >> (7 - (i & 7)) & 1:
                break
            block = i // RANK_BITS
            whole = self.bits[k][block * RANK_BITS // 8:i >> 3]
            last = int(self.bits[k][i >> 3]) >> (8 - (i & 7))
            i = int(self.ranks[k][block]) + int(np.bitwise_count(whole).sum()) + last.bit_count()
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop, level by level; only the asked range is touched."""
        out = np.zeros(stop - start, np.uint32)
        at, lo = np.arange(stop - start), start
        hi = stop
        for k, chunk in enumerate(self.chunks):
            if lo >= hi:
                break
            out[at] |= chunk[lo:hi].astype(np.uint32) << np.uint32(k * self.width)
            first = lo // 8
            more = np.unpackbits(self.bits[k][first:(hi + 7) // 8])[lo - first * 8:hi - first * 8].astype(bool)
            at = at[more]
            lo = self._rank(k, lo)
            hi = lo + len(at)
        return out

    def _rank(self, k: int, i: int) -> int:
        block = min(i // RANK_BITS, len(self.ranks[k]) - 1)
        bits = np.unpackbits(self.bits[k][block * RANK_BITS // 8:(i + 7) // 8])[:i - block * RANK_BITS]
        return int(self.ranks[k][block]) + int(bits.sum())


def encode_levels(ids: np.ndarray, width: int = WIDTH) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) per level."""
    kind = np.uint8 if width <= 8 else np.uint16
    mask = np.uint32((1 << width) - 1)
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > mask
        ones = np.concatenate([[0], np.cumsum(more)])
        levels.append(((rest & mask).astype(kind).tobytes(), np.packbits(more).tobytes(),
                       ones[0:len(rest) + 1:RANK_BITS].astype("<u4").tobytes()))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(width)


# ------------------------------------------------------------- the tokenizer
class PieceEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of a batch at most once.

    The library first cuts a text at the tokenizer's added tokens (such as an
    end marker written out in a text); the rest is encoded between them. There the
    byte-level pre-tokenizer always starts a new word at a space that is
    followed by a character other than white space, whatever stands before
    it. Cut there, a text falls into pieces whose ids don't depend on their
    neighbours. Pieces are cut, numbered and looked up as Arrow columns, not as
    Python strings; unknown ones are encoded by the library, joined into a few
    calls, and kept (text, ids) in Arrow and NumPy; from a full table those go
    that no later batch has met.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().values())
        # tokens that take in their surroundings, or that joined words could form, leave whole texts to the library
        self.simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or _WHITE.search(t.content) for t in added)
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.known, self.known_ids, self.known_at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Empty the table, but for the pieces at ``keep``."""
        if keep is None or len(keep) > CACHE_PIECES // 2:
            keep = np.zeros(0, np.int64)
        # pieces behind a space; ids of the i-th: known_ids[known_at[i]:known_at[i + 1]]; met since they came or were kept
        size = np.diff(self.known_at)[keep]
        end = np.cumsum(size)
        at = np.repeat(self.known_at[keep] - (end - size), size)
        self.known_ids = self.known_ids[at + np.arange(len(at))]
        self.known, self.known_at = self.known.take(pa.array(keep)), np.concatenate([np.zeros(1, np.int64), end])
        self.met = np.zeros(len(keep), bool)

    def ids(self, text: str) -> np.ndarray:
        """The library's own answer for one text."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        texts = [t or "" for t in texts]
        if not texts:
            return []
        if self.added is not None and any(map(self.added.search, texts)):
            return self._around_added(texts)
        if any(map(_ODD_SPACE.search, texts)):
            cut = [_CUT.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            pieces = pa.array(list(chain.from_iterable(cut)), pa.string())
            del cut
        else:
            lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
            sizes, pieces = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
            del lists
        first = np.cumsum(sizes) - sizes  # a text's first piece stands behind no space: it has an entry of its own
        heads = self._many(pieces.take(pa.array(first)).to_pylist())
        numbered = pieces.dictionary_encode()
        number = numbered.indices.to_numpy().astype(np.int64)
        distinct = numbered.dictionary
        del numbered, pieces
        number[first] = len(distinct) + np.arange(len(texts))
        used = np.zeros(len(distinct) + len(texts), bool)
        used[number] = True
        ids, start, size = self._pieces(distinct, used[:len(distinct)])
        lead = np.fromiter(map(len, heads), np.int64, len(heads))
        start = np.concatenate([start, len(ids) + np.cumsum(lead) - lead])
        size = np.concatenate([size, lead])
        ids = np.concatenate([ids, *heads])
        count = size[number]
        end = np.cumsum(count)
        at = np.repeat((start[number] - (end - count)).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        return np.split(ids[at], end[np.cumsum(sizes) - 1][:-1])

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """The library's own answer for each of several short texts."""
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.StringArray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where the ids of each used piece behind a space are."""
        if len(self.known) > CACHE_PIECES or len(self.known_ids) > 8 * CACHE_PIECES:
            self._forget(np.nonzero(self.met)[0])
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        self.met[place[place >= 0]] = True
        start = self.known_at[np.maximum(place, 0)]
        size = np.where(place < 0, 0, self.known_at[np.minimum(place, len(self.known) - 1) + 1] - start)
        new = np.nonzero((place < 0) & used)[0]
        text = pieces.take(pa.array(new))
        ids, own = self._learn(text)
        start[new] = len(self.known_ids) + np.cumsum(own) - own
        size[new] = own
        both = np.concatenate([self.known_ids, ids])
        short = pc.binary_length(text).to_numpy() <= KEPT_BYTES
        self.known = pa.concat_arrays([self.known, text.filter(pa.array(short))])
        self.known_ids = both if short.all() else np.concatenate([self.known_ids, ids[np.repeat(short, own)]])
        self.known_at = np.concatenate([self.known_at, self.known_at[-1] + np.cumsum(own[short])])
        self.met = np.concatenate([self.met, np.zeros(int(short.sum()), bool)])
        return both, start, size

    def _learn(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces behind a space, one after the other, and how many each has. Pieces are joined
        by spaces for the library: ids that begin with a space mark where each begins."""
        held, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for lo in range(0, len(pieces), JOINED_PIECES):
            some = pieces.slice(lo, JOINED_PIECES)
            # an empty piece has no ids; one with a space inside can't be told from two
            odd = pc.or_(pc.match_substring(some, " "), pc.equal(pc.binary_length(some), 0)).to_numpy(zero_copy_only=False)
            plain = some.filter(pa.array(~odd)) if odd.any() else some
            size = np.zeros(len(some), np.int64)
            ids = self._many([" " + _joined(plain)])[0] if len(plain) else held[0]
            at = np.nonzero(self.opens[ids])[0]
            if len(at) != len(plain):
                raise RuntimeError("words and ids don't match")
            size[~odd] = np.diff(np.append(at, len(ids)))
            if odd.any():
                parts = iter(np.split(ids, at[1:]) if len(plain) else [])
                apart = iter(some.filter(pa.array(odd)).to_pylist())
                each = [(self.ids(" " + p) if (p := next(apart)) else held[0]) if o else next(parts) for o in odd.tolist()]
                ids, size = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            held.append(ids)
            sizes.append(size)
        return np.concatenate(held), np.concatenate(sizes)

    def _around_added(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that hold added tokens, cut at them."""
        if not self.simple:
            return [self.ids(t) for t in texts]
        parts = [self.added.split(t) for t in texts]  # text, token, text, ...
        made = iter(self.encode_batch([p for ps in parts for p in ps[::2]]))
        token = lambda name: np.array([self.tok.token_to_id(name)], "<u4")
        return [np.concatenate([token(p) if k % 2 else next(made) for k, p in enumerate(ps)]) for ps in parts]


def _joined(pieces: pa.StringArray) -> str:
    one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(one, " ")[0].as_py()


_ODD_SPACE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
_WHITE = re.compile(r"\s")
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------ write and read
SHARD_SCHEMA = ("part int, first_place bigint, n_tokens bigint, width int, doc_ids binary, doc_known binary, "
                "doc_starts binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>")
_SHARD = pa.schema([("part", pa.int32()), ("first_place", pa.int64()), ("n_tokens", pa.int64()),
                    ("width", pa.int32()), ("doc_ids", pa.binary()), ("doc_known", pa.binary()),
                    ("doc_starts", pa.binary()), ("chunks", pa.list_(pa.binary())),
                    ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def _write_shards(tokenizer: str, end_id: int, width: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        place, docs, known, starts, parts, size = 0, [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            levels = encode_levels(ids, width)
            row = [part, place, len(ids), width, np.array(docs, "<i8").tobytes(), bytes(known),
                   np.array(starts, "<i8").tobytes(), *([lv[k] for lv in levels] for k in range(3))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARD)], schema=_SHARD)

        for batch in batches:
            ids_of, texts = batch.column("_id").to_pylist(), batch.column("_text")
            turn = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64)) // BATCH_CHARS
            edge = [0, *(np.nonzero(np.diff(turn))[0] + 1).tolist(), len(texts)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                for doc, own in zip(ids_of[lo:hi], enc.encode_batch(texts.slice(lo, hi - lo).to_pylist())):
                    docs.append(doc or 0)
                    known.append(doc is not None)
                    starts.append(size)
                    parts += (own, end)
                    size += len(own) + 1
                    if size >= shard_tokens:
                        yield shard()
                        place += size
                        docs, known, starts, parts, size = [], [], [], [], 0
            del batch, texts
        if docs:
            yield shard()
        docs, known, starts, parts = [], [], [], []
        release()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, width: int = WIDTH, shard_tokens: int = SHARD_TOKENS,
                 parts: int | None = None) -> None:
    """Write all ids of ``docs`` in ascending id order to ``path``."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    order = [F.col("_id").asc_nulls_last()]
    ranged = named.repartitionByRange(n, *order).sortWithinPartitions(*order, "_text")
    ranged.mapInArrow(_write_shards(tokenizer, end_id, width, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str, fn, schema: str) -> DataFrame:
    """Map every document's ids, read back from ``path``, by
    ``fn(ids: uint32 array) -> tuple`` into (doc_id, start, n_tokens, *schema)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part")
    total, offsets = 0, []
    for part, n in per_part.collect():  # a row per part: as many as the writer's partitions
        offsets.append((part, total))
        total += n
    at = spark.createDataFrame(offsets, "part int, _offset bigint")
    placed = shards.join(F.broadcast(at), "part")
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["width"], row["n_tokens"], list(zip(row["chunks"], row["bitmaps"], row["ranks"])))
                docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
                starts = np.frombuffer(row["doc_starts"], "<i8")
                stops = np.append(starts[1:], row["n_tokens"])
                ids = s.tokens(0, s.n)
                got = [fn(ids[a:z]) for a, z in zip(starts, stops)]
                first = row["_offset"] + row["first_place"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d if k else None for d, k in zip(docs, row["doc_known"])], pa.int64()),
                     pa.array(starts + first, pa.int64()), pa.array(stops - starts, pa.int64()),
                     *(pa.array([g[i] for g in got]) for i in range(len(names)))],
                    ["doc_id", "start", "n_tokens", *names])

    return placed.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def crc32_ids(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

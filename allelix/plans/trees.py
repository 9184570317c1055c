"""Histogram trees over binned blocks: second-order boosting (M2) and forests (M1).

Binning. Every feature of the vector column becomes a bin number: a nominal
feature (ML attribute with values) keeps its category index, another one is
cut at up to ``NUMERIC_BINS`` learned quantiles. No category is capped, merged or hashed.
Rows are packed into blocks of bytes, written once to the shared folder, and read by all passes.

Splits. Numeric: bin <= cut goes left. Nominal: category = cut goes left, the
split that a one-hot column offers. A node's histogram holds only the bins
that occur in it, so a feature of many categories costs a node no more than its rows.

Distribution. In each pass tasks add up histograms of their blocks, one row per (tree,
node, feature); rows meet by that key, are summed, and the best split of the node
comes out; the driver gets a few rows per node and never a histogram. Nodes of
at most ``local_rows`` rows are finished in one task each, which gets their
rows: so the deep levels cost one shuffle instead of a pass each, a task's rows
stay bounded, and the splits are the same. Boosting finishes a round's trees that
way once all of their open nodes are small. A table of at most ``whole_rows`` rows
has no passes: every core gets a copy of the blocks, and grows trees of the forest, or,
in boosting, counts features of its own and tells the others the best split of each node. Boosting's passes count the rows of the
smaller child of a split only: the other child's histogram is the parent's, which
the merging tasks keep from the pass before, less that one.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, workers_find_package

NUMERIC_BINS = 255
BLOCK_ROWS = 65_536
# blocks that a task of a boosting pass reads where there are more than some for each core
TASK_BLOCKS = 8
# cells of a (tree, feature) histogram that are kept as one array; beyond, only those that occur
DENSE_CELLS = 2_000_000
# nodes of at most so many (in a forest: drawn) rows are finished in one task; some 50 bytes a row
LOCAL_ROWS = 500_000
FOREST_LOCAL_ROWS = 100_000
# tables of at most so many rows are copied to every core; some 60 bytes a row, twice that while a tree grows
WHOLE_ROWS = 2_000_000
# rows whose derivatives are made at a time
CHUNK_ROWS = 16_384
# a core's share of fewer rows is counted before the others are told of it
SHARE_ROWS = 50_000
# a task that waits so long for another one gives up; a step takes a second or two
TALK_SECONDS = 900
# bytes of one copy's histograms; beyond, only the bins that occur are kept (passes)
WHOLE_BYTES = 128 << 20
# of an Arrow batch of blocks
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
# histograms that a merging task holds before it adds up those of one key
MERGE_BYTES = 64 << 20
# rounds of boosting between two reliable checkpoints of the margins
CHECKPOINT_ROUNDS = 20
MIN_GAIN = 1e-6
_TREE = 1 << 40


# ------------------------------------------------------------------- binning
class Binning:
    """``edges[i]``: upper bounds of a numeric feature's bins, None for a nominal one."""

    def __init__(self, edges: list, arity: list[int], names: list[str]):
        self.edges = [None if e is None else np.asarray(e, float) for e in edges]
        self.arity = list(arity)  # bins of each feature
        self.names = list(names)
        self.nominal = np.array([e is None for e in self.edges], bool)
        self.narrow = "u1" if max(self.arity, default=1) <= 256 else "<u2" if max(self.arity) <= 65_536 else "<i4"

    @classmethod
    def fit(cls, x: DataFrame, features: str) -> "Binning":
        meta = x.schema[features].metadata.get("ml_attr", {})
        size = meta.get("num_attrs") or x.select(F.size(vector_to_array(features))).first()[0]
        attrs = {a["idx"]: a for kind in meta.get("attrs", {}).values() for a in kind}
        named = {i: a["vals"] for i, a in attrs.items() if "vals" in a}
        values = {i: v for i, v in named.items() if len(v) > 2 and not attrs[i].get("ord")}
        ranges = {i: list(range(len(v))) for i, v in named.items() if attrs[i].get("ord")}  # bucket numbers: already bins
        numeric = [i for i in range(size) if i not in values and i not in ranges]
        fr = [i / NUMERIC_BINS for i in range(1, NUMERIC_BINS)]
        row = x.select(vector_to_array(features).alias("f")).agg(
            F.lit(0), *[F.percentile_approx(F.col("f")[i], fr, 10_000).alias(f"q{i}") for i in numeric]).first()
        edges = [None if i in values else ranges[i] if i in ranges else
                 sorted({float(e) for e in row[f"q{i}"] or [] if e == e}) for i in range(size)]
        return cls(edges, [len(values[i]) if i in values else len(edges[i]) + 1 for i in range(size)],
                   [attrs.get(i, {}).get("name", f"f{i}") for i in range(size)])

    def apply(self, values: np.ndarray) -> np.ndarray:
        """Rows of feature values -> rows of bins; NaN is in the last bin of a numeric feature."""
        out = np.empty(values.shape, np.int32)
        for i, e in enumerate(self.edges):
            out[:, i] = values[:, i] if e is None else np.searchsorted(e, values[:, i])
        return out

    def pack(self, bins: np.ndarray) -> bytes:
        """Column after column, in 1, 2 or 4 bytes a bin."""
        return b"".join(bins[:, i].astype(self._kind(i)).tobytes() for i in range(bins.shape[1]))

    def unpack(self, raw: bytes, n: int) -> np.ndarray:
        out, at = np.empty((n, len(self.arity)), np.int32), 0
        for i in range(len(self.arity)):
            out[:, i] = np.frombuffer(raw, self._kind(i), n, at)
            at += n * np.dtype(self._kind(i)).itemsize
        return out

    def columns(self, raw, n: int) -> list[np.ndarray]:
        """The columns of a packed block as they lie there."""
        out, at = [], 0
        for i in range(len(self.arity)):
            out.append(np.frombuffer(raw, self._kind(i), n, at))
            at += out[-1].nbytes
        return out

    def _kind(self, i: int) -> str:
        return "u1" if self.arity[i] <= 256 else "<u2" if self.arity[i] <= 65_536 else "<i4"

    def to_json(self) -> str:
        return json.dumps({"edges": [None if e is None else e.tolist() for e in self.edges], "arity": self.arity,
                           "names": self.names})

    @classmethod
    def from_json(cls, text: str) -> "Binning":
        return cls(**json.loads(text))


_BLOCK = "block bigint, n int, bins binary, label binary, weight binary"


def pack_blocks(x: DataFrame, binning: Binning, features: str, label: str, weight: str | None, classes: list) -> DataFrame:
    """The rows as blocks; labels become positions in ``classes``. Written once, so every pass sees the same blocks."""
    place = {float(c): i for i, c in enumerate(classes)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            bins, label, weight = (np.concatenate(c) for c in zip(*held))
            cols = [(part << 32) | seq, len(label), binning.pack(bins), label.astype("<i4").tobytes(), weight.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                ["block", "n", "bins", "label", "weight"])

        for b in batches:
            if not b.num_rows:
                continue
            values = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            label = np.array([place[v] for v in b.column("y").to_pylist()], np.int64)
            held.append((binning.apply(values), label, b.column("w").to_numpy()))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                seq, held, n = seq + 1, [], 0
        if held:
            yield block()

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = x.select(vector_to_array(features).alias("f"), F.col(label).cast("double").alias("y"), w.alias("w"))
    blocks = rows.mapInArrow(pack, _BLOCK).transform(cut_lineage)
    # a task reads about a block's rows: many small partitions would cost every pass more than the rows do
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return blocks.coalesce(max(1, -(-n // BLOCK_ROWS)))


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, min(spark.sparkContext.defaultParallelism,
                      sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))


class _Talk:
    """What tasks of one stage tell each other while they run, by files in the shared folder (Spark's own
    ``allGather`` answers once a second; it is asked once, for a folder that no other attempt uses)."""

    def __init__(self, task: BarrierTaskContext, folder: str, tasks: int):
        self.rank, self.tasks, self.step = task.partitionId(), tasks, 0
        self.folder = os.path.join(folder, task.allGather(uuid.uuid4().hex)[0])
        os.makedirs(self.folder, exist_ok=True)

    def all(self, message: list) -> list[list]:
        """The messages of all tasks for this step, in their order."""
        path = lambda step, rank: os.path.join(self.folder, f"{step}-{rank}")
        own = path(self.step, self.rank)
        with open(f"{own}.new", "w") as f:
            json.dump(message, f)
        os.replace(f"{own}.new", own)  # seen whole or not at all
        out: list[list] = []
        nap, until = 0.0005, time.monotonic() + TALK_SECONDS
        while len(out) < self.tasks:
            try:
                with open(path(self.step, len(out))) as f:
                    out.append(json.load(f))
                nap = 0.0005
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"task {len(out)} says nothing in {self.folder}") from None
                time.sleep(nap)
                nap = min(2 * nap, 0.01)
        if self.step > 1:  # all have gone on from there
            os.remove(path(self.step - 2, self.rank))
        self.step += 1
        return out


def _shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder, if tasks can open files in it."""
    url = urlparse(checkpoint_dir(spark))
    return url.path if url.scheme in ("", "file") else None


_batches = {"lock": threading.Lock(), "users": 0, "before": None}


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows that are blocks of some MB go to Python a few at a time: executors keep buffers of a batch's size beside
    their heap. Only how rows are put together changes, so that fits in other threads may see it."""
    with _batches["lock"]:
        if not _batches["users"]:
            _batches["before"] = spark.conf.get(BATCH_BYTES_KEY, "64m")
            spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
        _batches["users"] += 1
    try:
        yield
    finally:
        with _batches["lock"]:
            _batches["users"] -= 1
            if not _batches["users"]:
                spark.conf.set(BATCH_BYTES_KEY, _batches["before"])


def _copied(blocks: DataFrame, tasks: int) -> DataFrame:
    """Every block in each of ``tasks`` partitions."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("copy")
    return blocks.select("block", "n", "bins", "label", "weight", copies).repartitionById(tasks, "copy").drop("copy")


def _gathered(batches: Iterator[pa.RecordBatch], binning: Binning):
    """(block, rows) in the blocks' order; then columns of bins, labels and weights of all of them."""
    held = [(b.column("block")[i].as_py(), b.column("n")[i].as_py(), *(b.column(c)[i].as_buffer() for c in ("bins", "label", "weight")))
            for b in batches for i in range(b.num_rows)]
    held.sort(key=lambda r: r[0])
    each = [binning.columns(r[2], r[1]) for r in held]
    columns = [np.concatenate([c[f] for c in each]) for f in range(len(binning.arity))]
    label, weight = (np.concatenate([np.frombuffer(r[i], kind) for r in held]) for i, kind in ((3, "<i4"), (4, "<f8")))
    sizes = [r[:2] for r in held]
    held.clear()
    each.clear()
    pa.default_memory_pool().release_unused()  # the blocks aren't needed beside the columns
    return sizes, columns, label, weight


# --------------------------------------------------------------------- trees
class Trees:
    """All trees of a model as arrays; leaves point to themselves."""

    def __init__(self, binning: Binning, tree, heap, feature, cut, gain, value, n_trees: int):
        tree, heap = np.asarray(tree, np.int64), np.asarray(heap, np.int64)
        order = np.lexsort((heap, tree))
        self.binning = binning
        self.tree, self.heap = tree[order], heap[order]
        self.feature, self.cut = np.asarray(feature, np.int64)[order], np.asarray(cut, np.int64)[order]
        self.gain = np.asarray(gain, float)[order]
        self.value = np.asarray(value, float).reshape(len(order), -1)[order]
        key = self.tree * _TREE + self.heap
        split = self.feature >= 0
        self.root = np.searchsorted(key, np.arange(n_trees) * _TREE + 1)
        own = np.arange(len(key))
        left, right = (np.where(split, np.searchsorted(key, self.tree * _TREE + 2 * self.heap + k), own) for k in (0, 1))
        self.child = np.stack([left, right], axis=1) if len(own) else np.zeros((0, 2), np.int64)
        self.depth = int(self.heap.max()).bit_length() - 1 if len(own) else 0
        # a leaf asks any feature: both of its children are itself
        self.ask = np.maximum(self.feature, 0)

    def leaves(self, bins: np.ndarray, t: int) -> np.ndarray:
        """The node of tree ``t`` that each row ends in."""
        rows, node = np.arange(len(bins)), np.full(len(bins), self.root[t])
        nominal = self.binning.nominal
        for _ in range(self.depth):
            f = self.ask[node]
            b = bins[rows, f]
            right = np.where(nominal[f], b != self.cut[node], b > self.cut[node])
            node = self.child[node, right.astype(np.int64)]
        return node

    def importances(self):
        """Share of each feature in the gains, averaged over trees."""
        out = np.zeros(len(self.binning.arity))
        split = self.feature >= 0
        for t in range(len(self.root)):
            mine = split & (self.tree == t)
            one = np.bincount(self.feature[mine], self.gain[mine], len(out))
            out += one / one.sum() if one.sum() > 0 else 0
        return Vectors.dense(out / out.sum() if out.sum() > 0 else out)

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, cut, gain, value), a row per node; ``node`` counts from the root, 1: children 2 n and 2 n + 1."""
        rows = list(zip(self.tree.tolist(), self.heap.tolist(), self.feature.tolist(), self.cut.tolist(), self.gain.tolist(),
                        self.value.tolist()))
        return spark.createDataFrame(rows, "tree bigint, node bigint, feature bigint, cut bigint, gain double, value array<double>")


def _walk(binning: Binning, bins: np.ndarray, split: dict[int, tuple[int, int]], level: int) -> np.ndarray:
    """Heap numbers of the rows in one growing tree; 0 for rows in a finished leaf."""
    node = np.ones(len(bins), np.int64)
    if not level:
        return node
    size = 1 << level
    feature, cut = np.full(size, -1), np.zeros(size, np.int64)
    for heap, (f, c) in split.items():
        if heap < size:
            feature[heap], cut[heap] = f, c
    rows = np.arange(len(bins))
    for _ in range(level):
        f = feature[node]
        b = bins[rows, np.maximum(f, 0)]
        right = np.where(binning.nominal[f], b != cut[node], b > cut[node])
        node = np.where((f >= 0) & (node > 0), 2 * node + right, 0)
    return node


def _rows_at(binning: Binning, columns: list[np.ndarray], split: dict[int, tuple[int, int]], wanted) -> dict:
    """The rows of the ``wanted`` nodes of a tree (None: all rows); only ways that lead to one are gone."""
    need: set[int] = set()
    for node in wanted:
        while node and node not in need:
            need.add(node)
            node >>= 1
    at: dict[int, np.ndarray | None] = {1: None}
    for heap in sorted(need):  # a parent before its children
        if heap not in at or heap not in split:
            continue
        f, cut = split[heap]
        rows = at[heap]
        b = columns[f] if rows is None else columns[f][rows]
        right = b != cut if binning.nominal[f] else b > cut
        for child, side in ((2 * heap, ~right), (2 * heap + 1, right)):
            if child in need:
                found = np.nonzero(side)[0]
                at[child] = found if rows is None else rows[found]
    return {node: at[node] for node in wanted if node in at}


class _Histograms:
    """Sums over the rows of a task, per (tree, feature): arrays over (node, bin)."""

    def __init__(self, binning: Binning, sums: int):
        self.binning, self.sums = binning, sums
        self.dense: dict[tuple, np.ndarray] = {}
        self.rows: list[tuple] = []

    def add(self, tree: int, nodes: list[int], feature: int, where: np.ndarray, bins: np.ndarray, weights: list[np.ndarray | None]) -> None:
        """``where``: position in ``nodes`` of each row; a weight None counts the rows."""
        arity = self.binning.arity[feature]
        key = where * arity + bins
        cells = len(nodes) * arity
        if cells <= DENSE_CELLS:
            table = self.dense.get((tree, feature))
            if table is None:
                table = self.dense[tree, feature] = np.zeros((self.sums, cells))
            for k, w in enumerate(weights):
                table[k] += np.bincount(key, w, cells)
        else:
            seen, at = np.unique(key, return_inverse=True)
            self._emit(tree, nodes, feature, seen, np.stack([np.bincount(at, w, len(seen)) for w in weights]))

    def _emit(self, tree: int, nodes: list[int], feature: int, key: np.ndarray, table: np.ndarray) -> None:
        arity = self.binning.arity[feature]
        where = key // arity
        edge = np.searchsorted(where, np.arange(len(nodes) + 1)).tolist()
        for i, node in enumerate(nodes):
            a, z = edge[i], edge[i + 1]
            if z > a:
                self.rows.append((tree, node, feature, (key[a:z] % arity).astype("<i4").tobytes(),
                                  np.ascontiguousarray(table[:, a:z]).astype("<f8").tobytes()))

    def batch(self, nodes_of: dict[int, list[int]], alive: int) -> pa.RecordBatch:
        """A row per (tree, node, feature) with the bins that occur (sum number ``alive`` is not 0)."""
        for (tree, feature), table in self.dense.items():
            key = np.nonzero(table[alive])[0]
            self._emit(tree, nodes_of[tree], feature, key, table[:, key])
        cols = list(zip(*self.rows)) if self.rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(),
                                                                                 pa.binary()))],
                                          ["tree", "node", "feature", "bins", "sums"])


_HIST = "tree int, node bigint, feature int, bins binary, sums binary"


def _merged(batches: Iterator[pa.RecordBatch], arity: list[int], sums: int):
    """(tree, node, feature, bins, table) of the histograms that met in this task, summed."""
    held: dict[tuple, list] = {}
    size, limit = 0, MERGE_BYTES

    def added(parts: list) -> list:
        parts.sort()  # of those that came together, one order of summing
        bins = np.concatenate([np.frombuffer(b, "<i4") for b, _ in parts])
        table = np.concatenate([np.frombuffer(t, "<f8").reshape(sums, -1) for _, t in parts], axis=1)
        seen, at = np.unique(bins, return_inverse=True)
        return [(seen.astype("<i4").tobytes(), np.stack([np.bincount(at, row, len(seen)) for row in table]).astype("<f8").tobytes())]

    for b in batches:
        for tree, node, feature, bins, table in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "feature", "bins", "sums"))):
            held.setdefault((tree, node, feature), []).append((bins, table))
            size += len(bins) + len(table)
        if size > limit:  # what came so far is kept as one histogram a key, however many tasks sent some
            for key, parts in held.items():
                if len(parts) > 1:
                    held[key] = added(parts)
            size = sum(len(b) + len(t) for parts in held.values() for b, t in parts)
            limit = max(MERGE_BYTES, 2 * size)
    while held:
        (tree, node, feature), parts = held.popitem()
        (bins, table), = added(parts)
        yield tree, node, feature, np.frombuffer(bins, "<i4"), np.frombuffer(table, "<f8").reshape(sums, -1)


def _with_siblings(batches: Iterator[pa.RecordBatch], sums: int):
    """``_merged`` for one child of each split, and after each its sibling: the parent's histogram
    (rows with node 0) less the child's. The last sum counts rows: a bin without any is left out."""
    before: dict[tuple, tuple] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for b in batches:
            parents = pc.equal(b.column("node"), 0)
            for row in b.filter(parents).to_pylist():
                before[row["tree"], row["parent"], row["feature"]] = (row["bins"], row["sums"])
            yield b.filter(pc.invert(parents))

    for tree, node, feature, bins, table in _merged(counted(), [], sums):
        yield tree, node, feature, bins, table
        if (tree, node >> 1, feature) in before:
            of, rest = before[tree, node >> 1, feature]
            of, rest = np.frombuffer(of, "<i4"), np.frombuffer(rest, "<f8").reshape(sums, -1).copy()
            rest[:, np.searchsorted(of, bins)] -= table
            left = rest[-1] > 0
            yield tree, node ^ 1, feature, of[left], rest[:, left]


def _sides(bins: np.ndarray, table: np.ndarray, nominal: bool):
    """Left sums of each possible cut, and the total."""
    total = table.sum(axis=1, keepdims=True)
    if nominal:
        return bins, table, total
    return bins[:-1], np.cumsum(table, axis=1)[:, :-1], total


# ------------------------------------------------------------------ boosting
def _shrunk(g, alpha: float):
    """Soft threshold of the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the (soft-max) log-loss, a column per tree of the round."""
    if k <= 2:
        p = 1.0 / (1.0 + np.exp(-margin))
        y = label[:, None].astype(float)
        h = p * (1 - p)
    else:
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        y = (label[:, None] == np.arange(k)).astype(float)
        h = 2 * p * (1 - p)
    return (p - y) * weight[:, None], np.maximum(h, 1e-16) * weight[:, None]


class HistogramBoosted:
    """Second-order boosting: in every round one tree per class (one for two
    classes) is grown level by level on gradients and hessians, all trees of a
    round in the same passes. ``regAlpha`` / ``regLambda`` are L1 / L2 penalties of the leaf weights."""

    def __init__(self, classes, features: str, label: str, weight: str | None = None, seed: int = 42, maxIter: int = 100,
                 maxDepth: int = 5, stepSize: float = 0.1, regAlpha: float = 0.0, regLambda: float = 1.0,
                 minChildWeight: float = 1.0, local_rows: int = LOCAL_ROWS, whole_rows: int | None = None):
        self.classes, self.features, self.label, self.weight = list(classes), features, label, weight
        self.rounds, self.depth, self.rate = int(maxIter), int(maxDepth), float(stepSize)
        self.alpha, self.lam, self.min_child = float(regAlpha), float(regLambda), float(minChildWeight)
        self.local_rows = int(local_rows)
        self.whole_rows = (WHOLE_ROWS if local_rows == LOCAL_ROWS else self.local_rows) if whole_rows is None else int(whole_rows)

    def fit(self, x: DataFrame) -> "BoostedModel":
        spark = x.sparkSession
        workers_find_package(spark)
        binning = Binning.fit(x, self.features)
        k = len(self.classes)
        width = 1 if k <= 2 else k
        state = pack_blocks(x, binning, self.features, self.label, self.weight, self.classes)
        size = state.agg(F.sum("n").alias("rows"), F.count("n").alias("blocks")).first()
        if not size["rows"] and self.rounds:
            raise ValueError("no training rows")
        kept = 16 * sum(binning.arity) * width * 2 ** max(self.depth - 1, 0)
        folder = _shared_folder(spark)
        if self.rounds and size["rows"] <= (self.whole_rows if folder else min(self.whole_rows, self.local_rows)) and kept <= WHOLE_BYTES:
            nodes = self._whole(state, binning, size["rows"], width, k, folder)
            return BoostedModel(self.classes, self.features,
                                Trees(binning, *zip(*nodes), n_trees=self.rounds * width))
        state = state.withColumn("margin", F.lit(None).cast("binary"))
        state = state.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-size["blocks"] // TASK_BLOCKS)))
        old = None
        nodes: list[tuple] = []
        last: list[tuple[dict, dict]] | None = None
        for r in range(self.rounds):
            state = state.mapInArrow(_with_margins(binning, last, width, k), f"{_BLOCK}, margin binary, g binary, h binary")
            if r and r % CHECKPOINT_ROUNDS == 0:
                state = state.transform(cut_lineage)
            state = state.persist()
            trees: list[dict] = [{} for _ in range(width)]
            made: list[tuple] = []  # (class, heap, feature, cut, gain, value)
            counted, local = {c: [1] for c in range(width)}, {}
            level, sums = 0, None
            while counted and level < self.depth:
                sums, found = self._best(state, binning, trees, counted, sums, level + 1 < self.depth)
                if not level:  # the roots' own values, for trees without any split
                    made += [(c, 1, -1, 0, 0.0, self._leaf(f["g"], f["h"])) for (c, _), f in found.items()]
                counted, local, most, level = {}, {}, 0, level + 1
                for (c, heap), f in sorted(found.items()):
                    if f["gain"] <= MIN_GAIN:
                        continue
                    trees[c][heap] = (f["feature"], f["cut"])
                    made.append((c, heap, f["feature"], f["cut"], f["gain"], 0.0))
                    nl, nr = f["nl"], f["n"] - f["nl"]
                    for side, g, h in ((0, f["gl"], f["hl"]), (1, f["g"] - f["gl"], f["h"] - f["hl"])):
                        made.append((c, 2 * heap + side, -1, 0, 0.0, self._leaf(g, h)))
                    if level < self.depth:
                        counted.setdefault(c, []).append(2 * heap + int(nr < nl))
                        local.setdefault(c, []).extend((2 * heap, 2 * heap + 1))
                        most = max(most, nl, nr)
                if most > self.local_rows:
                    local = {}
                else:
                    counted = {}
            if sums is not None:
                sums.unpersist()
            if local:
                made += self._finish(state, binning, trees, local, width)
            # what was found last about a node holds: first made as a leaf, then split or finished elsewhere
            made = list({(m[0], m[1]): m for m in made}.values())
            if not made:
                raise ValueError("no training rows")
            last = [({}, {}) for _ in range(width)]
            for c, heap, f, cut, _, value in made:
                last[c][f < 0][heap] = value if f < 0 else (f, cut)
            nodes += [(r * width + m[0], *m[1:]) for m in made]
            if old is not None:
                old.unpersist()
            old = state
        if old is not None:
            old.unpersist()
        return BoostedModel(self.classes, self.features,
                            Trees(binning, *(zip(*nodes) if nodes else [()] * 6), n_trees=self.rounds * width))

    def _whole(self, blocks: DataFrame, binning: Binning, n: int, width: int, k: int, folder: str | None) -> list[tuple]:
        """All rounds in one stage. Each task has all rows and counts features of its own; the tasks
        tell each other the best split that they found for each node of a level, and go on with the best of these."""
        alpha, lam, least, rate, depth, rounds = self.alpha, self.lam, self.min_child, self.rate, self.depth, self.rounds
        spark = blocks.sparkSession
        tasks = max(1, min(-(-n // SHARE_ROWS), len(binning.arity)))
        # tasks that wait for each other have to run at the same time
        alone = not folder or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
        tasks = 1 if alone else min(tasks, _slots(spark))
        folder = None if tasks == 1 else os.path.join(folder, f"talk-{uuid.uuid4().hex}")

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank = TaskContext.get().partitionId()
            _, columns, label, weight = _gathered(batches, binning)
            label = label.astype(np.int8 if k < 128 else np.int32)
            if (weight == weight[0]).all():  # one number for all
                weight = np.broadcast_to(weight[0], len(label))
            talk = _Talk(BarrierTaskContext.get(), folder, tasks) if folder else None
            own = [f for f in range(len(columns)) if f % tasks == rank]
            margin = np.zeros((len(label), width))
            g, h = np.empty((2, width, len(label)))
            out: list[tuple] = []
            for r in range(rounds):
                for a in range(0, len(label), CHUNK_ROWS):
                    to = slice(a, a + CHUNK_ROWS)
                    for whole, part in zip((g, h), gradients(margin[to], label[to], weight[to], k)):
                        whole[:, to] = part.T
                for c in range(width):  # one class after the other: the rows of one tree's nodes are kept at a time
                    count = _Sums(binning, columns, own, g[c], h[c])
                    # (node, its rows (None: all), sums, histograms)
                    level = [(1, None, np.array([g[c].sum(), h[c].sum()]), count.sums(None))]
                    while level:
                        best: list[tuple] = []
                        if level[0][0].bit_length() <= depth:
                            for _, _, total, table in level:
                                gain, f, cut, left = count.best(table, total, alpha, lam, least)
                                best.append((gain, f, cut, *left.tolist()))
                            if talk:
                                best = [min(found, key=lambda b: (-round(b[0], 9), b[1], b[2])) for found in zip(*talk.all(best))]
                        deeper = []
                        for i, (heap, rows, total, table) in enumerate(level):
                            level[i] = None
                            if not best or best[i][0] <= MIN_GAIN:
                                value = float(-_shrunk(total[0], alpha) / (total[1] + lam) * rate)
                                out.append((r * width + c, heap, -1, 0, 0.0, value))
                                margin[slice(None) if rows is None else rows, c] += value
                                continue
                            gain, f, cut, left = *best[i][:3], np.array(best[i][3:])
                            out.append((r * width + c, heap, f, cut, gain, 0.0))
                            pair = _parted(binning, columns, rows, f, cut)
                            tables = [None, None]
                            if heap.bit_length() < depth:  # the children can be split too
                                few = int(len(pair[1]) < len(pair[0]))
                                tables[few] = count.sums(pair[few])
                                tables[1 - few] = table - tables[few]
                            deeper += [(2 * heap + s, pair[s], (left, total - left)[s], tables[s]) for s in (0, 1)]
                        level = deeper
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            cols = list(zip(*out)) if out and not rank else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, kd) for v, kd in zip(cols, kinds)],
                                             ["tree", "node", "feature", "cut", "gain", "value"])

        with _small_batches(spark):
            rows = _copied(blocks, tasks).mapInArrow(
                grow, "tree bigint, node bigint, feature int, cut bigint, gain double, value double", barrier=tasks > 1).collect()  # the model
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
        return [tuple(r) for r in rows]

    def _leaf(self, g: float, h: float) -> float:
        return float(-_shrunk(g, self.alpha) / (h + self.lam) * self.rate)

    def _best(self, state: DataFrame, binning: Binning, trees: list, counted: dict, before: DataFrame | None, keep: bool):
        """The histograms of a level's nodes (to be given back as ``before``; only if ``keep``) and the best split
        of each: {(class, node): sums, gain, feature, cut}. ``counted``: the root, or one child of each split."""
        alpha, lam, least, width = self.alpha, self.lam, self.min_child, len(trees)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _Histograms(binning, 3)
            for b in batches:
                for i in range(b.num_rows):
                    columns = binning.columns(b.column("bins")[i].as_buffer(), b.column("n")[i].as_py())
                    g, h = (np.frombuffer(b.column(c)[i].as_buffer(), "<f8").reshape(width, -1) for c in ("g", "h"))
                    for c, nodes in counted.items():
                        found = _rows_at(binning, columns, trees[c], nodes)
                        if nodes == [1]:
                            mine, where, gc, hc = slice(None), np.zeros(g.shape[1], np.int64), g[c], h[c]
                        else:
                            mine = np.concatenate([found[node] for node in nodes])
                            where = np.repeat(np.arange(len(nodes)), [len(found[node]) for node in nodes])
                            gc, hc = g[c][mine], h[c][mine]
                        if len(where):
                            for f, column in enumerate(columns):
                                out.add(c, nodes, f, where, column[mine], [gc, hc, None])
            yield out.batch(counted, 2)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[list] = []
            top: dict[tuple, tuple] = {}
            for tree, node, feature, bins, table in _with_siblings(batches, 3):
                cuts, left, ((g,), (h,), (n,)) = _sides(bins, table, bool(binning.nominal[feature]))
                gain, cut, sums = 0.0, -1, (0.0, 0.0, 0.0)
                if len(cuts):
                    gains = split_gains(left[0], left[1], g, h, alpha, lam, least)
                    i = int(np.round(gains, 9).argmax())
                    gain, cut, sums = float(gains[i]), int(cuts[i]), left[:, i].tolist()
                own = (-round(gain, 9), feature, len(rows))
                if (tree, node) not in top or own < top[tree, node]:
                    top[tree, node] = own
                held = (bins.astype("<i4").tobytes(), np.ascontiguousarray(table).astype("<f8").tobytes()) if keep else (None, None)
                rows.append([tree, node, feature, *held, False, cut, gain, *sums, g, h, n])
            for _, _, i in top.values():
                rows[i][5] = True
            if not keep:
                rows = [row for row in rows if row[5]]
            cols = list(zip(*rows)) or [()] * 14
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int64()] + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["tree", "node", "feature", "bins", "sums", "top", "cut", "gain", "gl", "hl", "nl", "g", "h", "n"])

        rows = state.select("n", "bins", "g", "h").mapInArrow(count, _HIST).withColumn("parent", F.shiftright("node", 1))
        if before is not None:
            rows = rows.unionByName(before.select("tree", F.lit(0).cast("bigint").alias("node"), "feature", "bins", "sums",
                                                  F.col("node").alias("parent")))
        sums = rows.repartition(_merge_tasks(state.sparkSession), "tree", "parent", "feature").mapInArrow(
            best, f"{_HIST}, top boolean, cut bigint, gain double, gl double, hl double, nl double, g double, h double, n double")
        if keep:
            sums = sums.persist()
        found: dict = {}
        for row in sums.where("top").drop("bins", "sums", "top").collect():  # a row per open node and merging task
            old = found.get((row["tree"], row["node"]))
            if old is None or (-round(row["gain"], 9), row["feature"], row["cut"]) < (-round(old["gain"], 9), old["feature"], old["cut"]):
                found[row["tree"], row["node"]] = row.asDict()
        if before is not None:
            before.unpersist()
        return sums if keep else None, found

    def _finish(self, state: DataFrame, binning: Binning, trees: list, local: dict, width: int) -> list[tuple]:
        """Grow the small nodes to the end, each in one task that gets the node's rows."""
        alpha, lam, least, rate, depth = self.alpha, self.lam, self.min_child, self.rate, self.depth

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    n = row["n"]
                    bins = None
                    out = []
                    for c, nodes in local.items():
                        g, h = (np.frombuffer(row[k], "<f8").reshape(width, -1)[c] for k in ("g", "h"))
                        bins = binning.unpack(row["bins"], n) if bins is None else bins
                        for node, r in _rows_of(_walk_open(binning, bins, trees[c], set(nodes)), nodes):
                            out.append((c, node, row["block"], len(r), binning.pack(bins[r]), g[r].tobytes(), h[r].tobytes()))
                    if out:
                        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 3
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                                                         ["tree", "node", "block", "n", "bins", "g", "h"])

        def grow(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["block"])
            columns = [np.concatenate(c) for c in zip(*(binning.columns(r["bins"], r["n"]) for r in rows))]
            g, h = (np.concatenate([np.frombuffer(r[c], "<f8") for r in rows]) for c in ("g", "h"))
            out = grow_boosted(binning, columns, g, h, rows[0]["node"], depth, alpha, lam, least, rate)
            cols = list(zip(*[(rows[0]["tree"], *o) for o in out]))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tree", "node", "feature", "cut", "gain", "value"])

        sent = state.mapInArrow(send, "tree int, node bigint, block bigint, n int, bins binary, g binary, h binary")
        rows = sent.groupBy("tree", "node").applyInArrow(
            grow, "tree int, node bigint, feature int, cut bigint, gain double, value double").collect()  # the round's trees
        return [tuple(r) for r in rows]


def split_gains(gl, hl, g, h, alpha: float, lam: float, least: float) -> np.ndarray:
    """Gain of each cut with left sums (gl, hl); -1 where a side has too little hessian."""
    score = lambda a, b: _shrunk(a, alpha) ** 2 / (b + lam)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
    return np.where((hl >= least) & (h - hl >= least), gains, -1.0)


class _Sums:
    """Histograms of a node's derivatives over the bins of some features, one after the other."""

    def __init__(self, binning: Binning, columns: list[np.ndarray], own: list[int], g: np.ndarray, h: np.ndarray):
        self.columns, self.own, self.g, self.h = columns, own, g, h
        self.arity = [binning.arity[f] for f in own]
        self.start = np.cumsum([0, *self.arity])
        self.of = np.repeat(np.arange(len(own)), self.arity)
        self.nominal = binning.nominal[own][self.of]
        ends = np.zeros(len(self.of), bool)
        ends[self.start[1:] - 1] = True
        self.closed = ends & ~self.nominal  # a numeric feature's last bin leaves nothing on the right

    def sums(self, rows: np.ndarray | None) -> np.ndarray:
        g, h = (self.g, self.h) if rows is None else (self.g[rows], self.h[rows])
        table = np.empty((2, len(self.of)))
        for f, n, a, z in zip(self.own, self.arity, self.start, self.start[1:]):
            key = self.columns[f] if rows is None else self.columns[f][rows]
            key = key.astype(np.intp, copy=False)  # once for both
            table[0, a:z] = np.bincount(key, g, n)
            table[1, a:z] = np.bincount(key, h, n)
        return table

    def best(self, table: np.ndarray, total: np.ndarray, alpha: float, lam: float, least: float):
        """(gain, feature, cut, sums on the left)"""
        run = np.cumsum(table, axis=1)
        before = np.concatenate([np.zeros((2, 1)), run], axis=1)[:, self.start[self.of]]
        left = np.where(self.nominal, table, run - before)
        gains = np.where(self.closed, -1.0, split_gains(left[0], left[1], total[0], total[1], alpha, lam, least))
        i = int(np.round(gains, 9).argmax())
        return float(gains[i]), int(self.own[self.of[i]]), int(i - self.start[self.of[i]]), left[:, i]


def _parted(binning: Binning, columns: list[np.ndarray], rows: np.ndarray | None, f: int, cut: int) -> list[np.ndarray]:
    """The rows on both sides of a split."""
    b = columns[f] if rows is None else columns[f][rows]
    side = b == cut if binning.nominal[f] else b <= cut
    return [np.nonzero(s)[0] if rows is None else rows[s] for s in (side, ~side)]


def grow_boosted(binning: Binning, columns: list[np.ndarray], g, h, heap: int, depth: int, alpha: float, lam: float, least: float,
                 rate: float) -> list[tuple]:
    """All nodes below ``heap``, itself included: (heap, feature, cut, gain, leaf weight).

    One histogram over the bins of all features; a parent's less one child's is the other child's."""
    count = _Sums(binning, columns, list(range(len(columns))), g, h)
    out = []
    total = np.array([g.sum(), h.sum()])
    todo = [(heap, None, total, count.sums(None))]
    while todo:
        heap, rows, total, table = todo.pop()
        gain, f, cut, left = count.best(table, total, alpha, lam, least) if heap.bit_length() <= depth else (0.0, -1, 0, None)
        if gain <= MIN_GAIN:
            out.append((heap, -1, 0, 0.0, float(-_shrunk(total[0], alpha) / (total[1] + lam) * rate)))
            continue
        out.append((heap, f, cut, gain, 0.0))
        pair = _parted(binning, columns, rows, f, cut)
        both = [left, total - left]
        tables = [None, None]
        if heap.bit_length() < depth:  # the children can be split too
            few = int(len(pair[1]) < len(pair[0]))
            tables[few] = count.sums(pair[few])
            tables[1 - few] = table - tables[few]
        todo += [(2 * heap + k, pair[k], both[k], tables[k]) for k in (0, 1)]
    return out


def _rows_of(heap: np.ndarray, nodes: list[int]):
    """(node, its rows) for the nodes that have any."""
    order = np.argsort(heap, kind="stable")
    each = np.array(sorted(nodes))
    lo, hi = (np.searchsorted(heap[order], each, side=s).tolist() for s in ("left", "right"))
    for node, a, z in zip(each.tolist(), lo, hi):
        if z > a:
            yield node, order[a:z]


def _merge_tasks(spark: SparkSession) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _with_margins(binning: Binning, last: list[tuple[dict, dict]] | None, width: int, k: int):
    """Blocks whose margins take in the last round's trees (splits, leaf weights), with the new derivatives."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins, gs, hs = [], [], []
            for i in range(b.num_rows):
                n, raw, label, weight, margin = (b.column(c)[i] for c in ("n", "bins", "label", "weight", "margin"))
                n = n.as_py()
                margin = np.frombuffer(margin.as_buffer(), "<f8").reshape(n, width).copy() if margin.is_valid else np.zeros((n, width))
                if last is not None:
                    columns = binning.columns(raw.as_buffer(), n)
                    for c, (split, value) in enumerate(last):
                        for node, rows in _rows_at(binning, columns, split, value).items():
                            margin[slice(None) if rows is None else rows, c] += value[node]
                g, h = gradients(margin, np.frombuffer(label.as_buffer(), "<i4"), np.frombuffer(weight.as_buffer(), "<f8"), k)
                margins.append(margin.tobytes())
                gs.append(np.ascontiguousarray(g.T).tobytes())
                hs.append(np.ascontiguousarray(h.T).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("block", "n", "bins", "label", "weight")] +
                [pa.array(v, pa.binary()) for v in (margins, gs, hs)],
                ["block", "n", "bins", "label", "weight", "margin", "g", "h"])

    return update


class _TreeModel:
    """Common parts of the fitted models: scoring and storage."""

    kind = ""

    def __init__(self, classes, features: str, trees: Trees):
        self.classes, self.features, self.trees = list(classes), features, trees

    @property
    def featureImportances(self):  # noqa: N802 (the name that Spark's tree models use)
        return self.trees.importances()

    def transform(self, df: DataFrame) -> DataFrame:
        workers_find_package(df.sparkSession)
        from pyspark.sql.functions import pandas_udf
        score, binning, slots = self.scores, self.trees.binning, int(max(self.classes)) + 1
        place = [int(c) for c in self.classes]

        @pandas_udf("array<double>")
        def probabilities(values):
            import pandas as pd
            if not len(values):
                return pd.Series([], dtype=object)
            out = np.zeros((len(values), slots))  # like Spark's own vectors: slot c is class code c
            out[:, place] = score(binning.apply(np.stack(values.to_numpy())))
            return pd.Series(list(out))

        out = df.withColumn("probs", probabilities(vector_to_array(self.features)))
        return out.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("double"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.trees.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"classes": self.classes, "features": self.features, "binning": self.trees.binning.to_json(),
                "n_trees": len(self.trees.root)}
        spark.createDataFrame([(json.dumps(meta),)], "meta STRING").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str):
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        rows = spark.read.parquet(f"{path}/nodes").toPandas()
        trees = Trees(Binning.from_json(meta["binning"]), rows["tree"], rows["node"], rows["feature"], rows["cut"], rows["gain"],
                      np.stack(rows["value"]) if len(rows) else [], meta["n_trees"])
        return cls(meta["classes"], meta["features"], trees)


class BoostedModel(_TreeModel):
    kind = "boosted"

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Probabilities, a column per class."""
        k = len(self.classes)
        width = 1 if k <= 2 else k
        margin = np.zeros((len(bins), width))
        for t in range(len(self.trees.root)):
            margin[:, t % width] += self.trees.value[self.trees.leaves(bins, t), 0]
        if width == 1:
            p = 1.0 / (1.0 + np.exp(-margin[:, 0]))
            return np.stack([1 - p, p], axis=1)[:, :k] if k == 2 else np.ones((len(bins), 1))
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


# -------------------------------------------------------------------- forest
def _draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the tree's sample: a function of (seed, tree, block)."""
    return np.random.Generator(np.random.Philox(key=[(seed << 20) + tree, block])).poisson(1.0, n)


def node_features(seed: int, tree: int, heap: int, total: int, take: int) -> list[int]:
    """The features that a node may split on."""
    return np.random.Generator(np.random.Philox(key=[(1 << 60) + (seed << 20) + tree, heap])).permutation(total)[:take].tolist()


def _gini(table: np.ndarray) -> np.ndarray:
    """Weighted impurity (weight times Gini) of class weights along the first axis."""
    total = table.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, total - (table ** 2).sum(axis=0) / total, 0.0)


def _best_gini(bins, table, nominal: bool, min_leaf: int):
    """(gain, cut, left sums) of the best cut; the last sum is the count of draws."""
    cuts, left, total = _sides(bins, table, nominal)
    if not len(cuts):
        return 0.0, -1, None
    right = total - left
    gain = _gini(total[:-1]) - _gini(left[:-1]) - _gini(right[:-1])
    gain = np.where((left[-1] >= min_leaf) & (right[-1] >= min_leaf), gain, -1.0)
    i = int(np.round(gain, 9).argmax())
    return float(gain[i]), int(cuts[i]), left[:, i]


class HistogramForest:
    """Random forest: Poisson(1) bootstrap, ``sqrt`` of the features a node, Gini gain with row weights.

    ``minInstancesPerNode`` / ``minSamplesSplit`` count drawn rows."""

    def __init__(self, classes, features: str, label: str, weight: str | None = None, seed: int = 42, numTrees: int = 100,
                 maxDepth: int = 10, minInstancesPerNode: int = 1, minSamplesSplit: int = 2, local_rows: int = FOREST_LOCAL_ROWS,
                 whole_rows: int | None = None):
        self.classes, self.features, self.label, self.weight, self.seed = list(classes), features, label, weight, seed
        self.n_trees, self.depth = int(numTrees), int(maxDepth)
        self.min_leaf, self.min_split, self.local_rows = int(minInstancesPerNode), int(minSamplesSplit), int(local_rows)
        self.whole_rows = (WHOLE_ROWS if local_rows == FOREST_LOCAL_ROWS else self.local_rows) if whole_rows is None else int(whole_rows)

    def fit(self, x: DataFrame) -> "ForestModel":
        spark = x.sparkSession
        workers_find_package(spark)
        binning = Binning.fit(x, self.features)
        blocks = pack_blocks(x, binning, self.features, self.label, self.weight, self.classes).persist()
        trees: list[dict] = [{} for _ in range(self.n_trees)]
        made: list[tuple] = []
        n = blocks.agg(F.sum("n")).first()[0] or 0
        if not n:
            raise ValueError("no training rows")
        big = n > self.whole_rows
        if not big:
            made = self._whole(blocks, binning, n)
        open_nodes = {t: [1] for t in range(self.n_trees)} if big else {}
        local: dict[int, list[int]] = {}
        level = 0
        while open_nodes and level < self.depth:
            found = self._best(blocks, binning, trees, open_nodes, level)
            nxt: dict[int, list[int]] = {}
            for (t, heap), f in sorted(found.items()):
                total = np.array(f["total"])
                share = (total[:-1] / max(total[:-1].sum(), 1e-300)).tolist()
                if f["gain"] <= MIN_GAIN or total[-1] < self.min_split:
                    made.append((t, heap, -1, 0, 0.0, share))
                    continue
                trees[t][heap] = (f["feature"], f["cut"])
                made.append((t, heap, f["feature"], f["cut"], f["gain"], share))
                left = np.array(f["left"])
                for side, sums in ((0, left), (1, total - left)):
                    child = 2 * heap + side
                    if level + 1 == self.depth or np.count_nonzero(sums[:-1] > 1e-12) < 2:
                        made.append((t, child, -1, 0, 0.0, (sums[:-1] / max(sums[:-1].sum(), 1e-300)).tolist()))
                    elif sums[-1] <= self.local_rows:
                        local.setdefault(t, []).append(child)
                    else:
                        nxt.setdefault(t, []).append(child)
            open_nodes, level = nxt, level + 1
        if local:
            made += self._finish(blocks, binning, trees, local)
        blocks.unpersist()
        return ForestModel(self.classes, self.features,
                           Trees(binning, *(zip(*made) if made else [()] * 6), n_trees=self.n_trees))

    def _whole(self, blocks: DataFrame, binning: Binning, n: int) -> list[tuple]:
        """Every task gets all rows and grows some of the trees."""
        seed, k, take, depth, n_trees = self.seed, len(self.classes), self._take(binning), self.depth, self.n_trees
        min_leaf, min_split = self.min_leaf, self.min_split
        # a task's trees are worth its copy of the rows
        tasks = max(1, min(n_trees, _slots(blocks.sparkSession), -(-n * n_trees // SHARE_ROWS)))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes, columns, label, weight = _gathered(batches, binning)
            starts = np.cumsum([0, *[n for _, n in sizes]]).tolist()
            shares = np.bincount(label, weight, k)
            shares = (shares / max(shares.sum(), 1e-300)).tolist()  # of a tree that draws no row
            for t in range(TaskContext.get().partitionId(), n_trees, tasks):
                drawn = np.concatenate([_draws(seed, t, block, n).astype("u1") for block, n in sizes])
                mine = np.concatenate([a + np.nonzero(drawn[a:z])[0] for a, z in zip(starts, starts[1:])])
                times = drawn[mine].astype(float)
                out = grow_node(binning, [c[mine] for c in columns], label[mine], weight[mine] * times, times, k, seed, t, 1, depth, take,
                                min_leaf, min_split) if len(mine) else [(t, 1, -1, 0, 0.0, shares)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(zip(*out), kinds)],
                                                 ["tree", "node", "feature", "cut", "gain", "value"])

        with _small_batches(blocks.sparkSession):
            rows = _copied(blocks, tasks).mapInArrow(
                grow, "tree int, node bigint, feature int, cut bigint, gain double, value array<double>").collect()  # the model itself
        return [tuple(r) for r in rows]

    def _take(self, binning: Binning) -> int:
        return max(1, int(np.sqrt(len(binning.arity))))

    def _best(self, blocks: DataFrame, binning: Binning, trees: list, nodes_of: dict, level: int) -> dict:
        seed, k, take, min_leaf = self.seed, len(self.classes), self._take(binning), self.min_leaf
        total = len(binning.arity)
        # tree -> the features that each of its open nodes may use, a row per node
        asked = {t: np.array([node_features(seed, t, heap, total, take) for heap in nodes]) for t, nodes in nodes_of.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = []
            for b in batches:
                for row in b.to_pylist():
                    bins = binning.unpack(row["bins"], row["n"]).astype(binning.narrow).ravel()
                    blocks.append((row["block"], bins, np.frombuffer(row["label"], "<i4"), np.frombuffer(row["weight"], "<f8")))
            for t, nodes in nodes_of.items():  # a tree's histograms at a time
                out = _NodeHistograms(binning, t, nodes, asked[t], k)
                walk = _Descent(binning, trees[t], level)
                place = np.full(2 << level, -1)
                place[nodes] = np.arange(len(nodes))
                for block, bins, label, weight in blocks:
                    drawn = _draws(seed, t, block, len(label))
                    mine, node = walk(bins, np.nonzero(drawn)[0])
                    where = place[node]
                    if (where < 0).any():
                        mine, where = mine[where >= 0], where[where >= 0]
                    times = drawn[mine].astype(float)
                    out.add(where, bins, mine, label[mine], weight[mine] * times, times)
                yield out.batch()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top: dict[tuple, tuple] = {}
            for tree, node, feature, bins, table in _merged(batches, binning.arity, k + 1):
                gain, cut, left = _best_gini(bins, table, bool(binning.nominal[feature]), min_leaf)
                sums = table.sum(axis=1)
                own = (-round(gain, 9), feature, cut, gain, (sums * 0 if left is None else left).tolist(), sums.tolist())
                if (tree, node) not in top or own < top[tree, node]:
                    top[tree, node] = own
            cols = list(zip(*[(t, n, *v[1:]) for (t, n), v in top.items()])) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["tree", "node", "feature", "cut", "gain", "left", "total"])

        # the histograms of a merging task stay small, however many nodes a level has
        bins = float(np.mean(binning.arity)) * take * sum(map(len, nodes_of.values()))
        tasks = max(_merge_tasks(blocks.sparkSession), int(bins * (8 * (k + 1) + 4) / (MERGE_BYTES / 2)) + 1)
        rows = blocks.mapInArrow(count, _HIST).repartition(tasks, "tree", "node", "feature").mapInArrow(
            best, "tree int, node bigint, feature int, cut bigint, gain double, left array<double>, total array<double>").collect()
        found: dict = {}
        for row in rows:
            old = found.get((row["tree"], row["node"]))
            if old is None or (-round(row["gain"], 9), row["feature"], row["cut"]) < (-round(old["gain"], 9), old["feature"], old["cut"]):
                found[row["tree"], row["node"]] = row.asDict()
        return found

    def _finish(self, blocks: DataFrame, binning: Binning, trees: list, local: dict) -> list[tuple]:
        """Grow the rest of the small nodes, each in one task that gets the node's rows."""
        seed, k, take, depth = self.seed, len(self.classes), self._take(binning), self.depth
        min_leaf, min_split = self.min_leaf, self.min_split

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    bins = binning.unpack(row["bins"], row["n"])
                    label, weight = np.frombuffer(row["label"], "<i4"), np.frombuffer(row["weight"], "<f8")
                    for t, nodes in local.items():
                        drawn = _draws(seed, t, row["block"], row["n"])
                        mine = np.nonzero(drawn)[0]
                        out = []
                        for node, at in _rows_of(_walk_open(binning, bins[mine], trees[t], set(nodes)), nodes):
                            r = mine[at]
                            out.append((t, node, row["block"], len(r), binning.pack(bins[r]), label[r].astype("<i4").tobytes(),
                                        weight[r].tobytes(), drawn[r].astype("<u1").tobytes()))
                        if out:
                            cols = list(zip(*out))
                            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4
                            yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(cols, kinds)],
                                                             ["tree", "node", "block", "n", "bins", "label", "weight", "drawn"])

        def grow(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["block"])
            columns = [np.concatenate(c) for c in zip(*(binning.columns(r["bins"], r["n"]) for r in rows))]
            join = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
            label, drawn = join("label", "<i4"), join("drawn", "<u1").astype(float)
            weight = join("weight", "<f8") * drawn
            t = rows[0]["tree"]
            out = grow_node(binning, columns, label, weight, drawn, k, seed, t, rows[0]["node"], depth, take, min_leaf, min_split)
            cols = list(zip(*out))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            return pa.table([pa.array(c, kd) for c, kd in zip(cols, kinds)], names=["tree", "node", "feature", "cut", "gain", "value"])

        sent = blocks.mapInArrow(send, "tree int, node bigint, block bigint, n int, bins binary, label binary, weight binary, drawn binary")
        rows = sent.groupBy("tree", "node").applyInArrow(
            grow, "tree int, node bigint, feature int, cut bigint, gain double, value array<double>").collect()  # the model itself
        return [tuple(r) for r in rows]


class _Descent:
    """The rows of a growing tree that reach a level, and the nodes where they are; rows that end above are left out."""

    def __init__(self, binning: Binning, split: dict[int, tuple[int, int]], level: int):
        self.level, self.width = level, len(binning.arity)
        self.feature, self.cut = np.full(1 << level, -1), np.zeros(1 << level, np.int64)
        for heap, (f, c) in split.items():
            if heap < 1 << level:
                self.feature[heap], self.cut[heap] = f, c
        self.nominal = binning.nominal[self.feature] & (self.feature >= 0)
        self.ends, self.any_nominal = bool((self.feature[1:] < 0).any()), bool(self.nominal.any())

    def __call__(self, bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``bins``: row after row."""
        node = np.ones(len(rows), np.int64)
        for _ in range(self.level):
            f = self.feature[node]
            if self.ends and not (on := f >= 0).all():
                rows, node, f = rows[on], node[on], f[on]
            b, cut = bins[rows * self.width + f], self.cut[node]
            right = b > cut
            if self.any_nominal:
                right = np.where(self.nominal[node], b != cut, right)
            node = 2 * node + right
        return rows, node


class _NodeHistograms:
    """Sums over the rows of a task for one tree, where every node asks for features of its own:
    an array over (node, bin) for the first feature of all nodes, one for the second, ..."""

    def __init__(self, binning: Binning, tree: int, nodes: list[int], asked: np.ndarray, k: int):
        self.width, self.tree, self.nodes, self.asked, self.k = len(binning.arity), tree, nodes, asked, k
        sizes = np.asarray(binning.arity)[asked]
        self.start = np.concatenate([np.zeros((1, asked.shape[1]), np.int64), np.cumsum(sizes, axis=0)]).T.copy()
        self.column = asked.T.copy()  # a feature of every node, then the next
        self.dense: dict[int, list] = {}
        self.rows: list[tuple] = []

    def add(self, where: np.ndarray, bins: np.ndarray, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> None:
        """``where``: position in ``nodes`` of each of the rows."""
        k, at = self.k, rows * self.width
        for j in range(self.asked.shape[1]):
            cells = int(self.start[j, -1])
            key = self.start[j][where] + bins[at + self.column[j][where]]
            if cells <= DENSE_CELLS:
                sums = [np.bincount(key * k + label, weight, cells * k).reshape(cells, k), np.bincount(key, drawn, cells)]
                held = self.dense.setdefault(j, sums)
                if held is not sums:
                    held[0] += sums[0]
                    held[1] += sums[1]
            else:  # only the bins that occur
                seen, to = np.unique(key, return_inverse=True)
                self._emit(j, seen, np.bincount(to * k + label, weight, len(seen) * k).reshape(-1, k), np.bincount(to, drawn, len(seen)))

    def _emit(self, j: int, key: np.ndarray, weights: np.ndarray, drawn: np.ndarray) -> None:
        table = np.concatenate([weights.T, drawn[None]]).astype("<f8")
        edge = np.searchsorted(key, self.start[j]).tolist()
        for i, node in enumerate(self.nodes):
            a, z = edge[i], edge[i + 1]
            if z > a:
                self.rows.append((self.tree, node, int(self.asked[i, j]), (key[a:z] - self.start[j, i]).astype("<i4").tobytes(),
                                  table[:, a:z].tobytes()))

    def batch(self) -> pa.RecordBatch:
        """A row per (tree, node, feature) with the bins that occur."""
        for j, (weights, drawn) in self.dense.items():
            key = np.nonzero(drawn)[0]
            self._emit(j, key, weights[key], drawn[key])
        cols = list(zip(*self.rows)) if self.rows else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["tree", "node", "feature", "bins", "sums"])


def _walk_open(binning: Binning, bins: np.ndarray, split: dict[int, tuple[int, int]], stop: set[int]) -> np.ndarray:
    """Heap numbers of the rows where they stop: at a node of ``stop``, else 0."""
    node = np.ones(len(bins), np.int64)
    if not split:
        return node
    size = 2 * max(split) + 2
    feature, cut = np.full(size, -1), np.zeros(size, np.int64)
    for heap, (f, c) in split.items():
        feature[heap], cut[heap] = f, c
    rows = np.arange(len(bins))
    for _ in range(size.bit_length()):
        f = feature[node]
        b = bins[rows, np.maximum(f, 0)]
        right = np.where(binning.nominal[f], b != cut[node], b > cut[node])
        node = np.where(f >= 0, 2 * node + right, node)
    open_at = np.zeros(size, bool)
    open_at[list(stop)] = True
    return np.where(open_at[node], node, 0)


def grow_node(binning: Binning, columns: list[np.ndarray], label, weight, drawn, k: int, seed: int, tree: int, heap: int, depth: int, take: int,
              min_leaf: int, min_split: int) -> list[tuple]:
    """All nodes below ``heap``, itself included: (tree, heap, feature, cut, gain, class shares)."""
    out = []
    todo = [(heap, np.arange(len(label)))]
    while todo:
        heap, rows = todo.pop()
        y, w, d = label[rows], weight[rows], drawn[rows]
        total = np.bincount(y, w, k)
        share = (total / max(total.sum(), 1e-300)).tolist()
        best = (0.0, 0, -1, 0.0)
        if heap.bit_length() <= depth and np.count_nonzero(total > 1e-12) > 1 and d.sum() >= min_split:
            for f in node_features(seed, tree, heap, len(binning.arity), take):
                b = columns[f][rows].astype(np.intp)
                if binning.arity[f] > 4 * len(rows):  # only the bins that occur
                    seen, at = np.unique(b, return_inverse=True)
                    size = len(seen)
                else:
                    seen, at, size = None, b, binning.arity[f]
                table = np.empty((k + 1, size))
                table[:k] = np.bincount(at * k + y, w, size * k).reshape(size, k).T
                table[k] = np.bincount(at, d, size)
                if seen is None:
                    seen = np.nonzero(table[k])[0]
                    table = table[:, seen]
                gain, cut, _ = _best_gini(seen, table, bool(binning.nominal[f]), min_leaf)
                own = (-round(gain, 9), f, cut, gain)
                if gain > MIN_GAIN and own < best:
                    best = own
        if best[2] < 0:
            out.append((tree, heap, -1, 0, 0.0, share))
            continue
        _, f, cut, gain = best
        out.append((tree, heap, f, cut, gain, share))
        left, right = _parted(binning, columns, rows, f, cut)
        todo += [(2 * heap, left), (2 * heap + 1, right)]
    return out


class ForestModel(_TreeModel):
    kind = "forest"

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves."""
        out = np.zeros((len(bins), len(self.classes)))
        for t in range(len(self.trees.root)):
            out += self.trees.value[self.trees.leaves(bins, t)]
        return out / max(len(self.trees.root), 1)

"""Histogram trees: exact splits, the same trees by passes and in one task, storage."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from allelix.plans import trees as T


@pytest.fixture(scope="module")
def matrix(spark):
    """A learnable three-class table: two numeric features, one of 40 categories, one missing now and then."""
    df = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double").alias("b"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(40))).alias("cat"), F.col("id"))
    df = df.withColumn("label", F.when((F.col("a") > 5) & (F.col("cat") != "c7"), 1.0).when(F.col("b") >= 4, 2.0).otherwise(0.0))
    df = df.withColumn("a", F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("a")))
    df = df.withColumn("weight", F.lit(1.0) + F.col("id") % 3)
    x = StringIndexer(inputCol="cat", outputCol="ci", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "ci"], outputCol="features", handleInvalid="keep").transform(x).select(
        "id", "features", "label", "weight").repartition(4).persist()


def nodes(model):
    t = model.trees
    return list(zip(t.tree.tolist(), t.heap.tolist(), t.feature.tolist(), t.cut.tolist()))


def test_binning_and_bytes():
    b = T.Binning([[1.0, 2.0], None, list(range(300))], [3, 70_000, 301], ["a", "b", "c"])
    values = np.array([[0.5, 69_999, 0], [1.0, 0, 299], [1.5, 5, 300], [np.nan, 6, np.nan]])
    bins = b.apply(values)
    assert bins.tolist() == [[0, 69_999, 0], [0, 0, 299], [1, 5, 300], [2, 6, 300]]
    assert (b.unpack(b.pack(bins), 4) == bins).all()
    again = T.Binning.from_json(b.to_json())
    assert (again.apply(values) == bins).all() and again.names == b.names


def test_passes_and_single_tasks_grow_the_same_trees(matrix):
    for cls, few, more in ((T.HistogramBoosted, {"maxIter": 3, "maxDepth": 4}, {"regAlpha": 1.0, "regLambda": 10.0}),
                           (T.HistogramForest, {"numTrees": 4, "maxDepth": 5}, {"minInstancesPerNode": 3, "minSamplesSplit": 20})):
        for extra in ({}, more):
            grown = [cls([0, 1, 2], "features", "label", "weight", local_rows=rows, **few, **extra).fit(matrix)
                     for rows in (10**9, 700, 0)]
            assert nodes(grown[0]) == nodes(grown[1]) == nodes(grown[2])
            for other in grown[1:]:
                assert np.allclose(grown[0].trees.value, other.trees.value)
                assert np.allclose(grown[0].trees.gain, other.trees.gain)


def test_models_learn_and_probabilities_sum_to_one(matrix, spark, scratch):
    for model in (T.HistogramBoosted([0, 1, 2], "features", "label", maxIter=15, maxDepth=4).fit(matrix),
                  T.HistogramForest([0, 1, 2], "features", "label", "weight", numTrees=20, maxDepth=8).fit(matrix)):
        out = model.transform(matrix).select("id", "probs", "prediction", "label").collect()
        assert all(abs(sum(r.probs) - 1) < 1e-9 and min(r.probs) >= 0 for r in out)
        assert np.mean([r.prediction == r.label for r in out]) > 0.95
        assert sum(model.featureImportances.toArray()) == pytest.approx(1)
        model.save(f"{scratch}/{model.kind}")
        back = type(model).load(f"{scratch}/{model.kind}").transform(matrix).select("id", "probs").collect()
        assert {r.id: r.probs for r in back} == {r.id: r.probs for r in out}


def test_first_split_is_the_best_one(matrix):
    """All splits of the first round's roots, by brute force."""
    model = T.HistogramBoosted([0, 1, 2], "features", "label", maxIter=1, maxDepth=1, regAlpha=0.5, regLambda=2.0, stepSize=1.0).fit(matrix)
    rows = matrix.collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    bins, b = model.trees.binning.apply(x), model.trees.binning
    soft = lambda g: np.sign(g) * max(abs(g) - 0.5, 0)
    for c in range(3):
        g, h = 1 / 3 - (y == c), np.full(len(y), 2 * (1 / 3) * (2 / 3))
        best = None
        for f in range(3):
            for cut in range(b.arity[f]):
                left = bins[:, f] == cut if b.nominal[f] else bins[:, f] <= cut
                if left.sum() * h[0] < 1 or (~left).sum() * h[0] < 1:
                    continue
                part = lambda m: soft(g[m].sum()) ** 2 / (h[m].sum() + 2)
                gain = part(left) + part(~left) - part(left | True)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, cut, left)
        t = model.trees
        root = t.root[c]
        assert (t.feature[root], t.cut[root]) == best[1:3] and t.gain[root] == pytest.approx(best[0])
        for side, m in ((0, best[3]), (1, ~best[3])):
            assert t.value[t.child[root, side], 0] == pytest.approx(-soft(g[m].sum()) / (h[m].sum() + 2))


def test_binary_boosting_takes_weights_and_one_class_is_a_leaf(matrix):
    two = matrix.withColumn("label", (F.col("label") == 1).cast("double"))
    a = T.HistogramBoosted([0, 1], "features", "label", maxIter=5, maxDepth=3).fit(two)
    b = T.HistogramBoosted([0, 1], "features", "label", "weight", maxIter=5, maxDepth=3).fit(two)
    assert len(a.trees.root) == 5 and not np.allclose(a.trees.value[a.trees.root], b.trees.value[b.trees.root]) or nodes(a) != nodes(b) \
        or not np.allclose(a.trees.gain, b.trees.gain)
    one = T.HistogramForest([0], "features", "label", numTrees=2).fit(matrix.where("label = 0"))
    assert {r.prediction for r in one.transform(matrix).collect()} == {0.0}
    with pytest.raises(ValueError):
        T.HistogramForest([0, 1], "features", "label").fit(two.where("false"))


def test_forest_histograms_by_node_equal_brute_force(monkeypatch):
    import numpy as np
    from allelix.plans.trees import Binning, _Descent, _NodeHistograms, _walk
    rng = np.random.default_rng(5)
    binning = Binning([[0, 1, 2], None, [0.5], None], [4, 6, 2, 3], list("abcd"))
    bins = np.stack([rng.integers(0, a, 500) for a in binning.arity], axis=1).astype(np.int32)
    split = {1: (1, 2), 3: (0, 1)}  # node 2 is finished: its rows go no further
    rows = np.nonzero(rng.integers(0, 2, 500))[0]
    mine, node = _Descent(binning, split, 2)(bins.astype(binning.narrow).ravel(), rows)
    want = _walk(binning, bins[rows], split, 2)
    assert mine.tolist() == rows[want > 0].tolist() and node.tolist() == want[want > 0].tolist()
    label, weight, drawn = rng.integers(0, 3, 500), rng.random(500), rng.integers(1, 4, 500).astype(float)
    nodes, asked = [6, 7], np.array([[0, 3], [1, 2]])
    for cells in (2_000_000, 0):  # kept as arrays, or only the bins that occur
        monkeypatch.setattr("allelix.plans.trees.DENSE_CELLS", cells)
        out = _NodeHistograms(binning, 9, nodes, asked, 3)
        out.add(node - 6, bins.ravel(), mine, label[mine], weight[mine], drawn[mine])
        got = {(r[1], r[2]): (np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<f8").reshape(4, -1))
               for r in zip(*(out.batch().column(i).to_pylist() for i in range(5)))}
        assert len(got) == 4
        for i, heap in enumerate(nodes):
            for f in asked[i]:
                seen, table = got[heap, f]
                here = mine[node == heap]
                assert seen.tolist() == sorted(set(bins[here, f].tolist()))
                for b, col in zip(seen, table.T):
                    at = here[bins[here, f] == b]
                    assert np.allclose(col[:3], [weight[at][label[at] == c].sum() for c in range(3)]) and col[3] == drawn[at].sum()


def test_siblings_are_the_parent_less_the_counted_child():
    """Boosting's passes count one child of a split; the other one's histogram is the difference, bins without rows left out."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    b = T.Binning([[0, 1, 2], None, list(range(300))], [4, 6, 301], list("abc"))
    bins = np.stack([rng.integers(0, a, 400) for a in b.arity], axis=1).astype(np.int32)
    split = {1: (1, 2), 2: (0, 0), 3: (2, 150)}
    columns = b.columns(b.pack(bins), 400)
    assert all((c == bins[:, f]).all() for f, c in enumerate(columns))
    walked = T._walk(b, bins, split, 2)
    rows = T._rows_at(b, columns, split, [4, 5, 6, 7])
    assert {k: v.tolist() for k, v in rows.items()} == {k: np.nonzero(walked == k)[0].tolist() for k in (4, 5, 6, 7)}
    assert T._rows_at(b, columns, {}, [1]) == {1: None}
    one = T._walk(b, bins, split, 1)
    g, h = rng.normal(size=400), rng.random(400)

    def batch(nodes, of, root=False):
        out = T._Histograms(b, 3)
        for f in range(3):
            for n in nodes:
                r = np.nonzero(of == n)[0]
                out.add(0, [n], f, np.zeros(len(r), np.int64), bins[r, f], [g[r], h[r], None])
                out.rows += [(0, n, f, k, v) for _, _, _, k, v in out_rows(out)]
                out.dense = {}
        t = pa.table({c: list(v) for c, v in zip(("tree", "node", "feature", "bins", "sums"), zip(*out.rows))})
        node = t.column("node").to_pylist()
        t = t.append_column("parent", pa.array(node if root else [n >> 1 for n in node]))
        return t.set_column(1, "node", pa.array([0] * len(node))) if root else t

    def out_rows(out):
        return list(zip(*(c.to_pylist() for c in out.batch({0: [0]}, 2).columns)))[-1:]

    both = pa.concat_tables([batch([4, 7], walked), batch([2, 3], one, root=True)]).to_batches()
    got = {(n, f): (seen, table) for _, n, f, seen, table in T._with_siblings(iter(both), 3)}
    assert sorted(got) == [(n, f) for n in (4, 5, 6, 7) for f in range(3)]
    for (n, f), (seen, table) in got.items():
        here = np.nonzero(walked == n)[0]
        assert seen.tolist() == sorted(set(bins[here, f].tolist()))
        for k, w in enumerate((g, h, np.ones(400))):
            assert np.allclose(table[k], [w[here][bins[here, f] == v].sum() for v in seen])


def test_whole_tables_grow_the_trees_of_the_passes_in_one_stage(matrix, monkeypatch):
    """A copy of the rows in every task: boosting's tasks share the features, the forest's the trees; no passes, no job a round."""
    def none(*a, **b):
        raise AssertionError("a pass over the blocks")
    for cls, more in ((T.HistogramBoosted, {"maxIter": 6, "maxDepth": 4}), (T.HistogramForest, {"numTrees": 5, "maxDepth": 6})):
        by_pass = cls([0, 1, 2], "features", "label", "weight", local_rows=0, **more).fit(matrix)
        with monkeypatch.context() as m:
            m.setattr(cls, "_best", none)
            m.setattr(cls, "_finish", none)
            for share in (10**6, 1000):  # one task, three tasks
                m.setattr(T, "SHARE_ROWS", share)
                whole = cls([0, 1, 2], "features", "label", "weight", **more).fit(matrix)
                assert nodes(whole) == nodes(by_pass)
                assert np.allclose(whole.trees.value, by_pass.trees.value) and np.allclose(whole.trees.gain, by_pass.trees.gain)


def test_merging_holds_a_histogram_a_key_and_not_one_a_task(monkeypatch):
    """The forest's histograms of 2,000 tasks for two keys: what is held stays near two histograms."""
    import tracemalloc

    import pyarrow as pa
    monkeypatch.setattr(T, "MERGE_BYTES", 1 << 20)
    bins = np.arange(255).astype("<i4").tobytes()

    def sent():
        for task in range(2000):
            sums = np.stack([np.full(255, 1.0), np.full(255, float(task)), np.full(255, 0.5), np.full(255, 2.0)]).tobytes()
            yield pa.RecordBatch.from_pydict({"tree": [0, 0], "node": [1, 1], "feature": [3, 4], "bins": [bins] * 2, "sums": [sums] * 2})

    tracemalloc.start()
    got = {f: (seen, table) for _, _, f, seen, table in T._merged(sent(), [], 4)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == [3, 4] and most < 6 << 20  # 37 MB were sent
    for seen, table in got.values():
        assert seen.tolist() == list(range(255))
        assert np.allclose(table, np.array([[2000.0], [2000 * 1999 / 2], [1000.0], [4000.0]]) * np.ones(255))

"""The block and bucket steps of the suffix deduplication against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from allelix.llm import suffix_dedup as S
from tests.llm import brute


def by(tables, column):
    whole = pa.concat_tables(tables)
    return {v: whole.filter(pc.equal(whole.column(column), v)) for v in set(whole.column(column).to_pylist())}


def in_blocks(docs, n):
    blocks = [[] for _ in range(n)]
    for i, t in docs:
        blocks[hash((i, t)) % n].append((S.NO_ID if i is None else i, (t or "").encode()))
    tables = {b: pa.table({"_id": pa.array([x[0] for x in rows], pa.int64()),
                           "_raw": pa.array([x[1] for x in rows], pa.binary()), "block": pa.array([b] * len(rows))})
              for b, rows in enumerate(blocks) if rows}
    none = S._bits_table([], 0, [], [])
    shared = by([none, *map(S._answer_anchors, by([S._send_anchors(n)(t) for t in tables.values()], "bucket").values())],
                "block")
    sent = by([S._send_contexts(n)(t, shared.get(b, none)) for b, t in tables.items()], "bucket")
    smaller = by([none, *map(S._answer_contexts, sent.values())], "block")
    out = []
    for b, t in tables.items():
        own = S.Block(t)
        own.share(n, S._bits_of(shared.get(b, none), 0))
        masks = np.split(own.covered(n, S._bits_of(smaller.get(b, none), 1)), own.ends[:-1])
        cols = S.digest([None if i == S.NO_ID else int(i) for i in own.ids], own.raw, masks)
        out += list(zip(*(cols[c].to_pylist() for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    rng = random.Random(seed)
    chars = rng.choice(["ab", "abcdefgh ", "xyzé ", "a"])  # periodic ones too
    make = lambda n: "".join(rng.choice(chars) for _ in range(n))
    pool = [make(rng.randint(30, 160)) for _ in range(5)]
    docs = []
    for _ in range(rng.randint(1, 16)):
        parts = [rng.choice([rng.choice(pool), rng.choice(pool)[:rng.randint(0, 80)], rng.choice(pool)[rng.randint(0, 30):],
                             make(rng.randint(0, 40))]) for _ in range(rng.randint(0, 5))]
        docs.append((rng.choice([None, *range(12)]), "".join(parts)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(in_blocks(docs, rng.randint(1, 4)), key=key) == sorted(brute.repeats(docs), key=key)


@pytest.mark.parametrize("seed", range(6))
def test_equal_hashes_are_told_apart(seed, monkeypatch):
    monkeypatch.setattr(S, "row_hash", lambda rows, *more: np.zeros(len(rows), np.uint64))
    monkeypatch.setattr(S, "_CHUNK_ROWS", 7)
    test_random_texts(seed)

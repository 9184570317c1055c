"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from allelix.llm import quality_rules
from tests.llm import brute

SF001 = "/root/testdata/sf0.001"


def has_item(text, items, least=13):
    norm = lambda s: re.findall(r"[^\s.,;:!?\"'()\[\]{}*#%$&|<>`_]+", s.lower())
    w = norm(text or "")
    grams = {tuple(w[i:i + least]) for i in range(len(w) - least + 1)}
    return any(tuple(v[i:i + least]) in grams for v in map(norm, items) for i in range(max(0, len(v) - least + 1)))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "token_binary":
            assert docs.columns == before.columns
        old, new = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        ids = [r["doc_id"] for r in new]
        if name == "quality_rules":
            ok = {r["doc_id"] for r in old if not brute.quality(r["text"])[5]}
            assert set(ids) <= ok and len(ids) == len(set(ids))
            plain = {r.doc_id for r in quality_rules.ledger(before).where("fail_bits = 0").collect()}
            assert set(ids) == plain
        elif name == "near_dedup":
            want = {i for i, _, c in brute.near([(r["doc_id"], r["text"]) for r in old], n=5) if i == c}
            assert sorted(ids) == sorted(want)
        elif name == "decontaminate":
            assert sorted(ids) == sorted(r["doc_id"] for r in old if not has_item(r["text"], items))
        elif name == "source_mix":
            whole = {r["doc_id"]: r for r in old}
            words = brute.WORD.findall
            n = {}
            for r in new:
                full = whole[r["doc_id"]]
                assert r["source"] == full["source"] and r["n_chars"] == len(r["text"])
                assert set(words(r["text"])) <= set(words(full["text"]))
                n[r["doc_id"]] = n.get(r["doc_id"], 0) + len(words(r["text"]))
            sizes, taken = {}, {}
            for i, r in whole.items():
                assert n.get(i, 0) <= 2 * len(words(r["text"]))
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
                taken[r["source"]] = taken.get(r["source"], 0) + n.get(i, 0)
            for s, t in brute.targets(sizes).items():
                assert abs(taken[s] - t) <= max(0.05 * t, 64)
        else:
            tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
            got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in new)
            assert got == sorted(brute.tokens([(r["doc_id"], r["text"]) for r in old], tok))


def test_odd_rows_and_empty_tables(spark, case_dir, empty_dir, tmp_path):
    for d in (case_dir, empty_dir):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, empty_dir)
            path = f"{tmp_path}/{d.split('/')[-1]}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        if d == empty_dir:
            assert docs.count() == 0


def test_ablations(spark, case_dir):
    book = quality_rules.ledger(spark.read.parquet(f"{case_dir}/documents.parquet"))
    bits = [r.fail_bits for r in book.collect()]
    mask = quality_rules.STRICT.mask(quality_rules.RULES)
    for r in quality_rules.ablations(book, [quality_rules.BASE, quality_rules.STRICT]).collect():
        if r.version == "v1":
            bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
            assert r.failed == sum(bool(b & bit) for b in bits)
            assert r.kept == sum(not b & mask for b in bits)
            assert r.kept_without == sum(not b & (mask & ~bit) for b in bits)
            assert r.only_this == r.kept_without - r.kept

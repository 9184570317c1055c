"""Every opN query against a brute-force version of its contract, on odd cases."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from allelix.llm import queries as Q
from tests.llm import brute

SF001 = "/root/testdata/sf0.001"
none_last = lambda r: tuple((x is None, x) for x in r)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=none_last)


def sf_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module", params=["cases", "sf0.001"])
def data(request, spark, case_dir, case_rows):
    return (case_dir, case_rows) if request.param == "cases" else (SF001, sf_rows(spark))


def test_op2(spark, data):
    d, docs = data
    got = rows(Q.op2_pii_tagger(spark, d), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    order = ("email", "ip", "card", "phone")
    want = []
    for i, t, _ in docs:
        s = brute.pii_base(t)
        n = [sum(k == x for k, *_ in s) for x in order]
        want.append((i, *n, brute.sha(",".join(f"{k}:{a}:{z}" for k, a, z in s)), s))
    want.sort(key=lambda r: none_last(r[:6]))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for r, w in zip(got, want):
        every = [(k, int(a), int(z)) for k, a, z in spans_of(r[6])]
        assert set(w[6]) <= set(every) and every == sorted(every, key=lambda s: (order.index(s[0]), s[1]))


def test_op3(spark, data):
    d, docs = data
    got = rows(Q.op3_suffix_dedup(spark, d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats([r[:2] for r in docs]), key=none_last)


def test_op4(spark, data):
    d, docs = data
    got = rows(Q.op4_line_dedup(spark, d), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(brute.lines([r[:2] for r in docs]), key=none_last)


def test_op5(spark, data):
    d, docs = data
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    df = Q.op5_source_mix(spark, d).collect()
    assert sorted(((r.doc_id, r.size) for r in df), key=none_last) == sorted(
        ((i, len(brute.WORD.findall(t or ""))) for i, t, _ in docs), key=none_last)
    by_doc = {}
    for i, _, s in docs:
        by_doc[i] = s
    taken = {}
    for r in df:
        s = by_doc[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.05 * want[s], 64), (s, n, want[s])
    again = rows(Q.op5_source_mix(spark, d), "doc_id", "size", "taken")
    assert again == sorted(((r.doc_id, r.size, r.taken) for r in df), key=none_last)


def test_op6(spark, data):
    d, docs = data
    got = rows(Q.op6_minhash_dedup(spark, d), "doc_id", "n_shingles", "component_id", "kept")
    want = [(i, n, None if c == brute.BIG else c, (brute.BIG if i is None else i) == c)
            for i, n, c in brute.near([r[:2] for r in docs])]
    assert got == sorted(want, key=none_last)


def test_op8(spark, data):
    d, docs = data
    tok = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    got = rows(Q.op8_token_binary(spark, d), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(brute.tokens([r[:2] for r in docs], tok), key=none_last)


def spans_of(text):
    return [x.split(":") for x in text.split(",")] if text else []


def test_op9(spark, data):
    d, docs = data
    got = rows(Q.op9_secret_scan(spark, d), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = []
    for i, t, _ in docs:
        s = brute.secrets(t)
        n = [sum(k == x for k, *_ in s) for x in ("assign", "access", "hex")]
        want.append((i, *n, brute.sha(",".join(f"{k}:{a}:{z}" for k, a, z in s))))
    assert [r[:5] for r in got] == sorted(want, key=none_last)
    for r in got:  # base spans stay in the list, in order
        base = [":".join(x) for x in spans_of(r[5]) if x[0] != "token"]
        assert brute.sha(",".join(base)) == r[4]


def test_op10(spark, data):
    d, docs = data
    got = Q.op10_quality_rules(spark, d)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, *cols) == sorted(((i, *brute.quality(t)) for i, t, _ in docs), key=none_last)
    assert got.where("base_failed AND kept").count() == 0


def test_op11(spark, data):
    d, docs = data
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = rows(Q.op11_importance_resample(spark, d), "doc_id", "n_features", "weight", "score", "rank")
    assert got == sorted(brute.importance([r[:2] for r in docs], target), key=none_last)
    assert any(r[4] for r in got)


def test_op12(spark, data):
    d, _ = data
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("lang", "text").collect()]
    got = rows(Q.op12_phrase_mining(spark, d), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got == sorted(brute.collocations(docs)) and got


def test_op13(spark, data):
    d, docs = data
    got = rows(Q.op13_relative_parse(spark, d), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.passages([r[:2] for r in docs]), key=none_last)


def test_empty_tables(spark, empty_dir):
    for name, query in Q.QUERIES.items():
        assert query(spark, empty_dir).count() == 0, name

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import VOCABULARY, awkward, docs, invented
from voucherflow.llm import language as L


def field(seed, labels=3):
    r = np.random.default_rng(seed)
    return L.Field([str(k) for k in range(labels)], np.zeros((labels, 1)), r.normal(size=(labels, labels)).astype(np.float32), r.normal(size=labels).astype(np.float32), {})


def brute(e, transition, start):
    """Marginals by summing over all label paths."""
    from itertools import product
    n, k = e.shape
    out = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, p in enumerate(path):
            out[i, p] += w
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_sums_over_all_paths():
    f, e = field(1), np.random.default_rng(2).normal(size=(6, 3)).astype(np.float32)
    assert np.allclose(L.marginals(f, e, np.array([0, 6])), brute(e, f.transition, f.start), atol=1e-4)


@pytest.mark.parametrize("offsets", [[0, 1], [0, 31, 32, 64, 65], [0, 0, 40, 40, 200], [0, 32, 96, 1000]])
def test_chunked_pass_equals_plain_forward_backward(offsets):
    f, n = field(3, 4), offsets[-1]
    e = (np.random.default_rng(n).normal(size=(n, 4)) * 3).astype(np.float32)
    got = L.marginals(f, e, np.array(offsets))
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b > a:
            want, _ = L._forward_backward(e[None, a:b].astype(float), np.ones((1, b - a), bool), f.transition.astype(float), f.start.astype(float))
            assert np.allclose(got[a:b], want[0], atol=1e-4)


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(n, invented(n, 60, VOCABULARY[lang]), lang) for n, lang in enumerate(list(VOCABULARY) * 30)]
    return L.learn(docs(spark, rows), F.col("doc_id") < 60)


def test_held_out_texts(spark, learned):
    rows = [(n, invented(1000 + n, 40, VOCABULARY[lang]), lang) for n, lang in enumerate(list(VOCABULARY) * 10)]
    got = {r["doc_id"]: r for r in L.identify(docs(spark, rows), learned).collect()}
    assert all(got[n]["lang_pred"] == lang and 0.9 < got[n]["score"] <= 1 for n, _, lang in rows)


def test_code_switched_text_is_labelled_by_word(learned):
    text = invented(1, 12, VOCABULARY["en"]) + " " + invented(2, 30, VOCABULARY["de"])
    lang, _, words, runs = L.label_texts(learned, pa.array([text]))
    assert (lang, words.tolist()) == (["de"], [42])
    assert [r["lang"] for r in runs[0]] == ["en", "de"] and abs(runs[0][0]["words"] - 12) <= 2


def test_awkward_rows(spark, learned):
    got = [tuple(r)[:3] for r in L.identify(awkward(spark), learned).collect()]
    assert len(got) == 11
    assert sorted(g[0] or -1 for g in got if g[1] == L.UNKNOWN) == [-1, 2, 3, 4]
    assert L.learn(awkward(spark).where("false"), F.lit(True)) is None
    assert {r["lang_pred"] for r in L.identify(awkward(spark), None).collect()} == {L.UNKNOWN}
    kept = L.keep_known(awkward(spark), learned, 0.0)
    assert kept.columns == awkward(spark).columns and kept.count() == 7
    assert L.identify(awkward(spark).where("false"), learned).count() == 0


def test_id_lang_and_source_do_not_change_a_prediction(spark, learned):
    text = invented(5, 30, VOCABULARY["fr"])
    got = L.identify(docs(spark, [(1, text, "en", "x"), (2, text, None, None), (None, text, "de", "y")]), learned).select("lang_pred", "score").distinct().collect()
    assert len(got) == 1

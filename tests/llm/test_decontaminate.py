import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import decontaminate as D


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], last + 1 if x == y else max(row[n], row[n - 1])
    return row[-1]


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_lcs(a, b):
    assert D.lcs(np.array(a, int), np.array(b, int)) == slow_lcs(a, b)


@pytest.fixture(scope="module")
def world():
    r = random.Random(1)
    common = [f"c{chr(97 + n)}" for n in range(12)]
    rare = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(4000)]
    def prose(n):
        return [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)]
    return r, prose


def test_copies_and_paraphrases_are_found_and_clean_texts_left(spark, world):
    r, prose = world
    items = {k: prose(40 + 5 * k) for k in range(8)}
    rows, want = [(1000 + n, " ".join(prose(150))) for n in range(150)], set()
    for k, words in items.items():
        rows.append((k, " ".join(prose(70) + words + prose(50)).upper()))                               # a copy
        lost = [w for w in words if r.random() > 0.15]                                                     # words left out
        rows.append((100 + k, " ".join(prose(33) + lost + prose(20))))
        changed = [w if r.random() > 0.25 or n >= len(words) - 12 else r.choice(prose(9)) for n, w in enumerate(words)]    # words exchanged, the answer kept
        rows.append((200 + k, " ".join(prose(61) + changed)))
        want |= {(k, k), (100 + k, k), (200 + k, k)}
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()], "item_id long, text string, kind string")
    got = D.matches(docs(spark, rows), bench).collect()
    assert {(m["doc_id"], m["item_id"]) for m in got} == want
    assert {m["kind"] for m in got if m["doc_id"] < 100} == {"copy"} and all(m["lcs_share"] == 1 for m in got if m["doc_id"] < 100)
    split = D.matches(docs(spark, rows), bench, group_items=3)
    assert {(m["doc_id"], m["item_id"]) for m in split.collect()} == want


def test_copies_of_short_items_are_found_among_a_thousand(spark, world):
    r, prose = world
    items = {k: prose(r.randrange(8, 60)) for k in range(1000)}
    rows = [(k, " ".join(prose(150) + words + prose(150))) for k, words in items.items()]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(m["doc_id"], m["item_id"]) for m in D.matches(docs(spark, rows), bench).collect()}
    lost = [len(items[k]) for k in items if (k, k) not in got and len({w for w in items[k] if len(w) > 2}) >= 3]
    assert lost == []


def overlap_bound(window, passage, answer, weight, need):
    """What every pair that the checks confirm fulfils: the shared words in any order would be enough. It decides nothing in the operator; it is the brute force here."""
    words = lambda x: sum(x.count(t) for t in set(window) & set(x))
    heavy = [t for t in passage if weight[t] > 0]
    if not heavy or words(heavy) < need or words(passage) / len(passage) < D.PARAPHRASE:
        return False
    return words(passage) / len(passage) >= D.COPY or words(answer) / len(answer) >= D.ANSWER


@given(st.lists(st.integers(0, 9), min_size=1, max_size=20), st.lists(st.integers(0, 9), min_size=1, max_size=12), st.lists(st.integers(0, 9), min_size=1, max_size=30))
def test_the_overlap_bound_loses_nothing_that_the_checks_confirm(passage, answer, window):
    weight = np.array([0, 0, 0, 1, 1, 1, 1, 1, 1, 1.0])
    x, y, z = (np.array(v, np.int64) for v in (passage, answer, window))
    heavy = x[weight[x] > 0]
    need = min(D.MIN_TERMS, len(heavy)) or 1
    if D._check(z, weight, x, y, heavy, need):
        assert overlap_bound(window, passage, answer, weight, need)


def test_recall_by_item_length(spark, world):
    """Verbatim copies, copies with words left out and paraphrases of 400 items of 8 to 60 words, in three groups of items. Of the planted pairs that the checks confirm
    in some window, all verbatim copies and 0.95 or more of the others are found, whatever the length."""
    r, prose = world
    items = {k: " ".join(prose(r.randrange(8, 60))) for k in range(400)}
    rows = []
    for k, text in items.items():
        w = text.split()
        lost = [x for x in w if r.random() > 0.15]
        changed = [x if r.random() > 0.25 or n >= len(w) - 12 else r.choice(prose(9)) for n, x in enumerate(w)]
        rows += [(k, " ".join(prose(60) + w + prose(60))), (1000 + k, " ".join(prose(33) + lost + prose(40))), (2000 + k, " ".join(prose(61) + changed + prose(20)))]
    every = D.prepare(sorted(items.items()))
    texts = {d: [every.terms.get(w, -1) for w in D._words(t)] for d, t in rows}
    blocks = [t[a:a + D.BLOCK] for t in texts.values() for a in range(0, max(1, len(t)), D.BLOCK)]
    weight = D.weights(every, np.bincount([t for b in blocks for t in set(b) if t >= 0], minlength=len(every.terms)), len(blocks))
    want = set()
    for item, p, q in zip(every.ids, every.passages, every.answers, strict=True):
        heavy = p[weight[p] > 0]
        need = min(D.MIN_TERMS, len(heavy)) or 1
        for d in (item, 1000 + item, 2000 + item):
            windows = [[x for x in texts[d][a:a + 2 * D.BLOCK] if x >= 0] for a in range(0, len(texts[d]), D.BLOCK)]
            if any(overlap_bound(w, p.tolist(), q.tolist(), weight, need) and D._check(np.array(w), weight, p, q, heavy, need) for w in windows):
                want.add((d, item))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(m["doc_id"], m["item_id"]) for m in D.matches(docs(spark, rows), bench, group_items=150).collect()}
    assert {x for x in want if x[0] < 1000} <= got
    for kind in (1, 2):
        for low, high in ((8, 20), (20, 30), (30, 45), (45, 60)):
            mine = {(d, i) for d, i in want if d // 1000 == kind and low <= len(items[i].split()) < high}
            assert len(mine & got) >= 0.95 * len(mine), (kind, low, len(mine & got), len(mine))


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (None, "one two three four five six seven eight"), (5, "Ünï çode")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(awkward(spark), bench).collect()}
    assert (1, None) in got and all(d == 1 or i == 5 for d, i in got)
    assert D.matches(awkward(spark), bench.where("false")).count() == 0
    assert D.matches(awkward(spark).where("false"), bench).count() == 0

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import collocations as C
from voucherflow.llm import common

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
        yield [w for w in re.split(r"[ \t]+", piece) if w]


def brute(rows, threshold, longest, top):
    f, n, out = Counter(), Counter(), []
    for _, text, of, *_ in rows:
        lang = "und" if of is None else of
        for w in cut(text):
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    f = {k: v for k, v in f.items() if v >= threshold}
    inner = {(lang, big[i:i + size]) for (lang, big), v in f.items() for size in range(2, len(big)) for i in range(len(big) - size + 1) if v >= f[lang, big[i:i + size]]}
    for lang in {k[0] for k in f}:
        got = []
        for (of, p), a in f.items():
            if of == lang and len(p) > 1 and (of, p) not in inner:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                got.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, ln, r, n[lang], -s) for i, (s, a, p, ln, r) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(map(tuple, C.collocations(docs(spark, rows), **kw).collect()))


def some_rows(seed, n=150):
    r = random.Random(seed)
    words, ends = "a b c d ab A É é x1 _ über".split(), [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    text = ["".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 80))) for _ in range(n)]
    return [(i, t + " once upon a time" * r.randint(0, 2), r.choice(["en", "de", None, ""])) for i, t in enumerate(text)]


@pytest.mark.parametrize(("seed", "threshold", "longest", "top", "capacity"), [(1, 10, 5, 2000, 1 << 16), (2, 7, 5, 30, 8), (3, 3, 4, 2000, 3), (4, 40, 2, 2000, 2), (5, 1, 5, 50, 64)])
def test_equals_brute_force(spark, seed, threshold, longest, top, capacity):
    """Small capacities take much off the counters, over several partitions and some repeated passes; no frequent phrase is lost."""
    rows = some_rows(seed)
    assert run(spark, rows, threshold=threshold, longest=longest, top=top, capacity=capacity) == brute(rows, threshold, longest, top)


def test_hot_phrase(spark):
    rows = some_rows(9, 60) + [(1000, "hot words here " * 3_000, "en")] + [(2000 + i, "the very same text of many documents", "en") for i in range(100)]
    assert run(spark, rows, threshold=20, capacity=16) == brute(rows, 20, 5, 2000)


def test_awkward_rows(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in awkward(spark).collect()]
    assert sorted(map(tuple, C.collocations(awkward(spark), threshold=2).collect())) == brute(rows, 2, 5, 2000)
    assert run(spark, []) == [] and run(spark, [(1, None), (2, " .,\t\n"), (3, "one")], threshold=1) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB É.,\n\t x ", max_size=30)), max_size=8))
def test_words(texts):
    flat, first = C.split_words(pa.array(texts, pa.string()))
    want = [(w, i == 0) for t in texts for piece in cut(t) for i, w in enumerate(piece)]
    assert list(zip(flat.to_pylist(), first.tolist(), strict=True)) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=40), min_size=1, max_size=6), st.integers(1, 8), st.integers(1, 4))
def test_merged_summaries_keep_their_bound(tasks, capacity, parts):
    """Added over tasks, a counter is at most its key's count and at least that less the loss of its partition; no summary is over capacity."""
    true, merged, lost = Counter(), Counter(), Counter()
    for items in tasks:
        held = C.Summary(parts, capacity)
        for a in range(0, len(items), 5):
            keys, n = np.unique(np.array(items[a:a + 5], np.uint64) << np.uint64(58), return_counts=True)
            held.add(keys, n)
            held.settle()
            assert not len(held.keys) or np.bincount(C.dealt(held.keys, parts)).max() <= capacity
        true.update(int(i) << 58 for i in items), merged.update(dict(zip(held.keys.tolist(), held.counts.tolist(), strict=True)))
        lost.update(held.lost)
    mass = Counter()
    for k, n in true.items():
        mass[int(C.dealt(np.array([k], np.uint64), parts)[0])] += n
    for k, n in true.items():
        p = int(C.dealt(np.array([k], np.uint64), parts)[0])
        assert n - lost[p] <= merged[k] <= n and lost[p] <= mass[p] / (capacity + 1)


def test_sets_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "ARRAY_KEYS", 7)
    keys = np.random.default_rng(3).integers(0, 1 << 64, 100, np.uint64)
    held = C.store_keys(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), str(tmp_path))
    assert held.buckets == 15 and held.has(keys).all() and not held.has(keys + np.uint64(1)).any()


def test_rows_of_codes_stay_arrays():
    """A task holds a row's words and hashes, and the phrases it counts, as arrays, not as an object for each."""
    batch = next(C._encode([pa.RecordBatch.from_arrays([pa.array(["a b a b, b a"]), pa.array(["en"])], ["text", "lang"])]))
    row, = C._rows(batch)
    assert isinstance(row["words"], pa.StringArray) and isinstance(row["hashes"], pa.Int64Array)
    codes = C._codes(row["codes"])
    assert C._texts(row["words"], codes, np.array([1, 6]), 2).to_pylist() == ["a b", "b a"]


def test_counted_phrases_are_added_by_key():
    held, want, r = C.Counted(), Counter(), np.random.default_rng(1)
    for _ in range(5):
        keys, n = np.unique(r.integers(0, 40, 30).astype(np.uint64) << np.uint64(58), return_counts=True)
        held.add(keys, n, pa.array([f"w {k}" for k in keys.tolist()]))
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    held.settle()
    (keys, n, texts), = held.parts
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and texts.to_pylist() == [f"w {k}" for k in keys.tolist()]


def test_a_small_hold_passes_phrases_on_and_counts_the_same(spark, monkeypatch):
    rows = some_rows(11)
    monkeypatch.setattr(C, "HELD", 5)
    assert run(spark, rows, threshold=5) == brute(rows, 5, 5, 2000)

import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs, invented
from voucherflow.llm import kneser_ney as K


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", lower) + ["\n"]


class Slow:
    """The model from its formulas, in dictionaries."""

    def __init__(self, texts):
        self.c, self.pair = Counter(), Counter()
        for t in map(tokens, texts):
            self.c.update(t), self.pair.update(zip(["<s>", *t[:-1]], t, strict=True))
        self.n, self.v, self.types = sum(self.c.values()), len(self.c), len(self.pair)
        self.after, self.contexts = defaultdict(lambda: [0, 0, 0, 0]), Counter()
        for (u, w), n in self.pair.items():
            self.after[u][0] += n
            self.after[u][min(n, 3)] += 1
            self.contexts[w] += 1
        four = Counter(min(n, 5) for n in self.pair.values())
        self.d = K.discounts([four[k] for k in (1, 2, 3, 4)])
        four = Counter(min(n, 5) for n in self.contexts.values())
        self.e = K.discounts([four[k] for k in (1, 2, 3, 4)])
        many = sum(n >= 3 for n in self.contexts.values())
        self.rest = (self.e[1] * four[1] + self.e[2] * four[2] + self.e[3] * many) / self.types if self.types else 1.0

    def one(self, w):
        n = self.contexts.get(w, 0)
        return (max(n - self.e[min(n, 3)], 0) / self.types if self.types else 0) + self.rest / (self.v + 1)

    def two(self, u, w):
        if u not in self.after:
            return self.one(w)
        total, n1, n2, n3 = self.after[u]
        n = self.pair.get((u, w), 0)
        return max(n - self.d[min(n, 3)], 0) / total + (self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3) / total * self.one(w)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return len(t), sum(w in self.c for w in t), base, sum(math.log10(self.two(u, w)) for u, w in zip(["<s>", *t[:-1]], t, strict=True))


@pytest.mark.parametrize("bucket", [100, 1 << 20])
def test_scores_equal_the_formulas(spark, monkeypatch, bucket):
    monkeypatch.setattr(K, "WORD_BUCKET", bucket), monkeypatch.setattr(K, "PAIR_BUCKET", bucket)
    words = [f"w{i}" for i in range(40)]
    train = [(n, invented(n, 5 + 7 * n % 60, words[: 5 + n % 35])) for n in range(40)] + [(99, None), (98, "A a\tB\x0bÉ é x")]
    test = train + [(200, "w1 w2 unseen w3 w3 W3"), (201, ""), (None, "never seen at all")]
    slow = Slow([t for _, t in train])
    got = K.score(docs(spark, test), K.fit(docs(spark, train))).collect()
    assert len(got) == len(test)
    by_id = {r["doc_id"]: r for r in got}
    for key, text in test:
        n, known, base, score = slow.score(text)
        r = by_id[key]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, slow.n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)
    assert sum(slow.two("w1", w) for w in slow.c) + slow.two("w1", "unseen") == pytest.approx(1)


def test_awkward_rows_and_no_training(spark):
    got = K.score(awkward(spark), K.fit(awkward(spark)))
    assert got.count() == 11 and got.where("score IS NULL OR isnan(score) OR score > 0").count() == 0
    none = K.score(awkward(spark), K.fit(awkward(spark).where("false"))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 and abs(r["score"]) < 1e-9 for r in none)
    assert K.score(awkward(spark).where("false"), K.fit(awkward(spark))).count() == 0


@given(st.lists(st.integers(0, 1000), min_size=4, max_size=4))
def test_discounts_never_exceed_their_count(n):
    d = K.discounts(n)
    assert d[0] == 0 and all(0 < d[k] <= k for k in (1, 2, 3))

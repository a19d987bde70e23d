import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, docs
from voucherflow.llm import mixing as M

def domain():
    return F.coalesce(F.substring("source", 1, 1), F.lit("-"))



def test_fill():
    assert M.fill(10, {"a": 100, "b": 100}, {"a": 1, "b": 3}) == {"a": 2.5, "b": 7.5}
    assert M.fill(10, {"a": 1, "b": 100}, {"a": 1, "b": 1}) == {"a": 1, "b": 9}
    assert M.fill(10, {"a": 1, "b": 2}, {"a": 1, "b": 1}) == {"a": 1, "b": 2}
    assert M.fill(10, {"a": 5, "b": 5}, {"a": 0, "b": 1}) == {"a": 0, "b": 5} or M.fill(10, {"a": 5, "b": 5}, {"a": 0, "b": 1})["b"] == 5


def test_siblings_come_before_ancestors():
    leaves = {("x", "en", "s1"): 10, ("x", "en", "s2"): 1000, ("x", "de", "s3"): 1000, ("y", "en", "s4"): 1000}
    got = M.leaf_budgets(leaves, 400, 1)
    # x and y get 200; x splits to 100 each language; s1 gives 10 of its 50 and s2 alone takes up the other 40
    assert got == {("x", "en", "s1"): 10, ("x", "en", "s2"): 90, ("x", "de", "s3"): 100, ("y", "en", "s4"): 200}
    short = {**leaves, ("x", "en", "s2"): 20}
    got = M.leaf_budgets(short, 400, 1)
    assert (got[("x", "en", "s1")], got[("x", "en", "s2")], got[("x", "de", "s3")], got[("y", "en", "s4")]) == (10, 20, 170, 200)


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.8, 1), (1.0, 2), (5.0, 2)])
def test_leaves_give_their_budget(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(M, "RANGE_ROWS", 25)
    r = random.Random(2)
    rows = [(n, "w " * r.randint(1, 30), r.choice(["en", "de", None]), r.choice(["a1", "a1", "a1", "a2", "b1", None])) for n in range(800)]
    table = docs(spark, rows)
    got = M.select(table, domain(), share, epochs, temperature=0.5)
    used = {}
    for x in got.collect():
        used.setdefault((x["mix_domain"], x["lang"], x["source"]), []).append(x)
    have = {}
    for n, text, lang, source in rows:
        have.setdefault(((source or "-")[0], lang, source), []).append(len(text.split()))
    budgets = M.leaf_budgets({k: sum(v) for k, v in have.items()}, share * sum(map(sum, have.values())), epochs, None, 0.5)
    for leaf, sizes in have.items():
        taken = used.get(leaf, [])
        total = sum(x["mix_tokens"] * x["mix_epochs"] for x in taken)
        assert budgets[leaf] - 1 <= total <= budgets[leaf] + max(sizes) + 1
        assert {x["mix_epochs"] for x in taken} <= set(range(1, epochs + 1))
    again = {(x["doc_id"], x["mix_epochs"]) for x in M.select(table.repartition(5), domain(), share, epochs, temperature=0.5).collect()}
    assert again == {(x["doc_id"], x["mix_epochs"]) for xs in used.values() for x in xs}


def test_awkward_rows(spark):
    got = M.select(awkward(spark), domain(), 0.9, 1)
    assert set(awkward(spark).columns) < set(got.columns) and 0 < got.count() <= 11
    assert M.select(awkward(spark).where("false"), domain(), 0.5).count() == 0
    assert M.select(awkward(spark), domain(), 9.0, 1).count() == 11

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import graph
from voucherflow.llm import simhash as S


def slow_fingerprint(text, n):
    w = text.lower().split()
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "a b c d a b c d a b", "x " * 500 + "é Ü y"])
def test_fingerprint(text):
    assert S.fingerprint(S.shingle_hashes(text.replace("Ü", "ü"), 4)) == slow_fingerprint(text.replace("Ü", "ü"), 4)


def test_only_ascii_is_lowered_and_split():
    assert S.shingle_hashes("Ä B", 4).tolist() == [xxhash.xxh64_intdigest("Ä b".encode(), 42)]


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def brute(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def linked(spark, fps, **sizes):
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) * 2 for f in fps], "id long, fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in graph.components(S.links(nodes, len(fps), 4, 3, 1, **sizes)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    return [roots.get(s, s) for s in signed]


@pytest.mark.parametrize("sizes", [{}, {"leaf": 8}, {"leaf": 8, "sample": 50}, {"leaf": 20, "tile": 5}])
def test_components_equal_brute_force(spark, sizes):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    while len(fps) < 260:           # chains and clusters
        fps.append(near(rng, rng.choice(fps), rng.randint(1, 6)))
    fps = sorted(set(fps))
    got, want = linked(spark, fps, **sizes), brute(fps, 4)
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 5), st.integers(0, 4))
def test_no_tree_loses_a_pair_within_its_reach(values, blocks, radius):
    fps = np.unique(np.array(values + [v ^ 5 for v in values], np.uint64))
    for mask in S.bit_blocks(blocks):
        tree = S.grow(fps, 1, mask, radius // blocks, 3, 1.0, 1000)
        who, leaf, home = tree.route(fps)
        assert sorted(who[home]) == list(range(len(fps)))
        at = dict(zip(who[home].tolist(), leaf[home].tolist(), strict=True))
        visits = set(zip(who.tolist(), leaf.tolist(), strict=True))
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (int(fps[i] ^ fps[j]) & mask).bit_count() <= radius // blocks:
                    assert (i, at[j]) in visits


def test_awkward_rows(spark):
    got = S.components(awkward(spark)).collect()
    assert len(got) == 11
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert S.components(awkward(spark).where("false")).count() == 0
    only_null = S.components(docs(spark, [(None, "a b"), (None, "a b")])).collect()
    assert [r["component_id"] for r in only_null] == [None, None]


def test_near_unique_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(6)]
    rows = [(100 + k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        for n in range(3):
            copy = list(w)
            copy[rng.randrange(len(copy))] = f"new{n}"          # 5 of about 296 shingles change
            rows.append((200 + 10 * k + n, " ".join(copy)))
    rows += [(100, rows[0][1]), (None, "quite another text of its own here"), (None, "and one more with no id at all")]
    table = docs(spark, rows)
    got = S.near_unique(table)
    assert got.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, -1, 100, 101, 102, 103, 104, 105]
    kept = S.near_unique(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 5, 7, 7]


def pair_of(rng, shared, one, other):
    """Two texts of 5-word shingles of their own each: `shared` in both, further ones at the ends."""
    w = [f"v{rng.randrange(10**9)}" for _ in range(shared + 4)]
    return [" ".join(w + [f"v{rng.randrange(10**9)}" for _ in range(n)]) for n in (one, other)]


@pytest.mark.parametrize(("shared", "one", "other", "near"), [
    (8, 1, 1, True), (80, 10, 10, True), (320, 40, 40, True), (85, 8, 7, True), (340, 30, 30, True), (90, 5, 5, True), (360, 40, 0, True), (4, 1, 0, True),
    (80, 11, 10, False), (3, 1, 0, False), (300, 50, 50, False), (280, 60, 60, False)])
def test_near_unique_links_all_pairs_of_similarity_08_and_no_others(spark, shared, one, other, near):
    rng = random.Random(shared)
    rows = [(2 * k + side, t) for k in range(60) for side, t in enumerate(pair_of(rng, shared, one, other))]
    kept = {r["doc_id"] for r in S.near_unique(docs(spark, rows)).collect()}
    assert kept == (set(range(0, 120, 2)) if near else set(range(120)))


def test_near_unique_compares_candidates_that_share_only_frequent_shingles(spark):
    rng = random.Random(4)
    footer = " ".join(f"f{n}" for n in range(104))      # 100 shingles in every text
    rows = [(n, footer + " " + " ".join(f"v{rng.randrange(10**9)}" for _ in range(30))) for n in range(40)]
    rows += [(100 + n, rows[n][1] + " new words here") for n in range(40)]
    assert {r["doc_id"] for r in S.near_unique(docs(spark, rows)).collect()} == set(range(40))


def test_graph_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 80)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=12), min_size=1, max_size=40), st.integers(1, 40), st.integers(2, 5))
def test_shared_members(sets, first, few):
    first = min(first, len(sets))
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    rest = sets if first == len(sets) else sets[first:]
    before, S.FEW = S.FEW, few
    try:
        got = S.shared_members(arrays, first)
    finally:
        S.FEW = before
    off = ~np.eye(len(sets), dtype=bool) if first == len(sets) else np.ones((first, len(rest)), bool)
    assert (got == np.array([[len(a & b) for b in rest] for a in sets[:first]]).reshape(got.shape))[off].all()


def test_groups_over_several_tiles(spark, monkeypatch):
    """A group whose members are near the first only, cut into tiles of five by five, and groups of two, that go together."""
    monkeypatch.setattr(S, "GROUP_TILE", 5)
    monkeypatch.setattr(S.near_edges, "__defaults__", (5,))
    rng = random.Random(6)
    base = [f"w{n}" for n in range(304)]
    rows = [(0, " ".join(base))]
    for n in range(1, 30):      # each lacks another run of 40 words, so two of them are under 0.8 and each is over 0.8 with the base
        at = rng.randrange(0, 264)
        rows.append((n, " ".join(base[:at] + base[at + 40:])))
    rows += [(100 + 2 * k + side, t) for k in range(20) for side, t in enumerate(pair_of(rng, 80, 10, 10))]
    assert {r["doc_id"] for r in S.near_unique(docs(spark, rows)).collect()} == {0, *range(100, 140, 2)}
    assert S.near_plan(50_000) == (4, 6) and S.near_plan(15_000_000)[0] > 4

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import line_dedup as L


@settings(max_examples=200)
@given(st.lists(st.integers(1, 9), max_size=25), st.lists(st.integers(1, 9), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    got = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    if a == b:
        assert got == [(n, n) for n in range(len(a))]


def test_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6, 7]
    assert L.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert L.common_blocks(a, b, [5] * 7, 10) == [(1, 2), (4, 5)] and L.common_blocks(a, b, [5] * 7, 11) == []


def line(r):
    return " ".join(f"w{r.randrange(10_000)}" for _ in range(10))


def test_shared_passages_go_from_the_later_document(spark):
    r = random.Random(3)
    passage, hot = [line(r) for _ in range(4)], line(r)
    own = {n: [line(r) for _ in range(6)] for n in range(60)}
    rows = {n: own[n][:3] + ([*passage] if n % 10 == 0 else []) + own[n][3:] + [hot, "short", ""] for n in range(60)}
    rows[70] = rows[5]
    got = {x["doc_id"]: x for x in L.dedup(docs(spark, [(n, "\n".join(v)) for n, v in rows.items()])).collect()}
    assert got[0]["n_deleted"] == 0 and got[0]["text"] == "\n".join(rows[0])
    for n in range(1, 60):
        left = got[n]["text"].split("\n")
        assert [x for x in left if x in own[n]] == own[n] and hot not in left
        assert not set(passage) & set(left)
    assert got[70]["text"] == "" and got[70]["n_deleted"] == len(rows[70])


def test_a_frequent_block_goes_though_each_of_its_lines_was_elsewhere_first(spark):
    x, y, z = "x1 x2 x3 x4 x5", "y1 y2 y3 y4 y5", "z1 z2 z3"
    block = {n: "\n".join([f"own a{n}", x, "", y, z, f"own b{n}"]) for n in range(4, 40)}
    rows = {1: f"{x}\nalone", 2: f"{y}\nalone too", 3: f"{x}\n\n{y}\nno third line", **block}
    got = {r["doc_id"]: r["text"] for r in L.dedup(docs(spark, list(rows.items()))).collect()}
    assert all(got[n] == rows[n] for n in (1, 2, 3))
    assert got[4] == f"own a4\n{z}\nown b4"
    assert all(got[n] == f"own a{n}\nown b{n}" for n in range(5, 40))


@settings(max_examples=200)
@given(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 6), st.data())
def test_runs_cover_every_line_of_a_block(words, least, data):
    import numpy as np
    lines = np.arange(1, len(words) + 1) * (np.array(words) > 0)
    own = np.array(words, np.int64)
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            if own[i:j].sum() < least:
                continue
            inside = L.line_runs(lines[i:j], own[i:j], least)
            assert inside <= L.line_runs(lines, own, least)
            covered = {n for n in range(i, j) if own[n] == 0 or own[n] >= least}
            for a in range(i, j):
                for b in range(a + 2, j + 1):
                    if L.xxhash.xxh64_intdigest(lines[a:b].tobytes(), 42) in inside:
                        covered |= set(range(a, b))
            assert covered == set(range(i, j))


def test_a_passage_repeated_in_the_first_holder_goes_from_later_documents(spark):
    r = random.Random(8)
    passage = [line(r) for _ in range(3)]
    rows = {0: ["u u", *passage, "v v", *passage, "w w"], **{n: [f"s{n}", *passage, f"t{n}"] for n in range(1, 12)}}
    got = {x["doc_id"]: x["text"] for x in L.dedup(docs(spark, [(n, "\n".join(v)) for n, v in rows.items()])).collect()}
    assert got[0] == "\n".join(rows[0]) and all(got[n] == f"s{n}\nt{n}" for n in range(1, 12))


@settings(max_examples=200)
@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(1, 4), max_size=20), st.sampled_from([1, 30, 1 << 28]))
def test_a_stretch_without_anchors_is_aligned_exactly(a, b, bits):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], last + 1 if x == y else max(row[n], row[n - 1])
    kept, L.TABLE_BITS = L.TABLE_BITS, bits
    try:
        got = sorted(L.longest(a, 0, len(a), b, 0, len(b)))
    finally:
        L.TABLE_BITS = kept
    assert len(got) == row[-1] and all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_frequent_lines_need_no_pairs_among_all_holders(spark):
    documents = L.with_lines(docs(spark, [(n, "a line that very many documents share") for n in range(40)])).withColumnRenamed("doc_id", "key")
    assert {tuple(r) for r in L.pairs(documents.select("key", "lines"), rare=8).collect()} == {(0, n) for n in range(1, 40)}
    few = L.pairs(documents.where("key < 5").select("key", "lines"), rare=8)
    assert {tuple(r) for r in few.collect()} == {(a, b) for b in range(5) for a in range(b)}


def test_awkward_rows(spark):
    got = L.dedup(awkward(spark)).collect()
    assert len(got) == 11
    assert [r["n_deleted"] for r in got if r["doc_id"] == 1] == [0, 0] and [r["text"] for r in got if r["doc_id"] == 6] == [""]
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert L.dedup(awkward(spark).where("false")).count() == 0


def test_words_are_runs_of_other_characters(spark):
    """Tabs, runs of spaces and carriage returns are no words: indented code and aligned tables keep their short lines."""
    short = ["\t" * 8 + "}", "x        =        1", "a \t b\r", "    return  None    ;"]
    long = "one two\tthree  four five six seven eight"
    rows = [(n, "\n".join([f"own {n}", *short, f"mine {n}"])) for n in range(3)] + [(10 + n, f"first {n}\n \t{long}{' ' * n}\r\nlast {n}") for n in range(3)]
    got = {r["doc_id"]: r["text"] for r in L.dedup(docs(spark, rows[:3] + rows[3:])).collect()}
    words = L.with_lines(docs(spark, [(1, "\n".join([*short, long, " \t\r", ""]))])).first()
    assert list(words["words"]) == [1, 3, 2, 3, 8, 0, 0] and words["lines"][5] == words["lines"][6] == 0
    assert got[10] == dict(rows)[10] and got[11] == "first 1\nlast 1" and got[12] == "first 2\nlast 2"


def test_short_common_blocks_stay(spark):
    block = "\t\tif x:\n\t\t\t\t}\n\t\tend"       # four words in three indented lines
    rows = [(n, f"head {n}\n{block}\ntail {n}") for n in range(5)]
    assert {r["doc_id"]: r["text"] for r in L.dedup(docs(spark, rows)).collect()} == dict(rows)


def test_the_whole_operator_against_all_pairs(spark):
    """Every later document aligned with every earlier one by brute force; blocks are of lines that a document holds once."""
    r = random.Random(8)
    blocks = [[line(r) if r.random() < 0.6 else f"s{r.randrange(10**6)} t" for _ in range(r.randint(1, 5))] for _ in range(25)]
    rows = []
    for n in range(70):
        parts = r.sample(blocks, r.randint(0, 3))
        text = [x for b in parts for x in [*b, f"own {n} {r.randrange(10**6)}"]]
        rows.append((n, r.choice(["\n", "\r\n"]).join([f"start {n}", *text])))
    want = {}
    lines = [t.split("\n") for _, t in rows]
    key = [[x.strip(" \t\r") for x in t] for t in lines]
    for b in range(len(rows)):
        gone = set()
        for a in range(b):
            for first, last in L.common_blocks([hash(x) for x in key[a]], [hash(x) for x in key[b]], [len(x.split()) for x in key[b]], L.MIN_WORDS):
                gone |= set(range(first, last + 1))
        want[b] = "\n".join(x for n, x in enumerate(lines[b]) if n not in gone)
    assert {x["doc_id"]: x["text"] for x in L.dedup(docs(spark, rows)).collect()} == want

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voucherflow.llm import vector_codes as V

SCHEMA = "vec_id long, e array<double>, label string, code string, state int"


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * max(1, math.ceil(max([len(v) for _, v, _ in kept] or [0]) / parts))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[v + [0] * (width - len(v))][0] for _, v, _ in kept]
    first = [v + [0] * (width - len(v)) for _, v, _ in order[:entries]]
    w = width // parts
    books = [[f[p * w:(p + 1) * w] for f in first] for p in range(parts)]

    def near(v, p):
        return min((sum((a - c) ** 2 for a, c in zip(v[p * w:(p + 1) * w], e, strict=True)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(v, p)[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for n in range(len(first)):
                mine = [v[p * w:(p + 1) * w] for v, g in zip(x, got, strict=True) if g[p] == n]
                if mine:
                    books[p][n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[near(v, p) for p in range(parts)] for v in x]
    return [(i, lab, bytes(n for _, n in f), sum(d for d, _ in f)) for (i, _, lab), f in zip(kept, final, strict=True)], books


def key(r):
    return repr(tuple(r))


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], SCHEMA).repartition(3)
    codes = V.compress(frame, "e", "label", **kw)
    return sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in codes.rows.collect()), key=key), codes


@pytest.mark.parametrize(("seed", "parts", "entries", "width", "scale"), [(1, 4, 8, 8, 50), (2, 2, 16, 8, 4096), (3, 8, 3, 16, 3)])
def test_equals_brute_force(spark, seed, parts, entries, width, scale):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.choice(["a", "b", None])) for i in range(400)]
    rows += [(1000 + i, list(rows[5][1]), "a") for i in range(200)]            # a third of the rows are one vector
    rows += [(2000 + i, [float(r.randint(-1, 1)) for _ in range(width)], "t") for i in range(150)]     # many equal distances
    got, codes = run(spark, rows, parts=parts, entries=entries, scale=scale)
    want, books = brute(rows, parts, entries, 6, scale)
    assert got == sorted(want, key=key) and codes.codebooks.tolist() == books
    assert len(codes.computed) == 7 and codes.computed[0] == len(rows) * parts * entries
    assert max(codes.computed[2:]) < codes.computed[0]                          # bounds save distances
    assert all(a >= b for a, b in zip(codes.lists, codes.lists[1:], strict=False))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0], "a"), (3, [1.0, 2.0, 3.0], "a"), (None, [0.5], None), (1, None, "a"), (2, [1.0, None], "a"), (4, [nan], "a"), (5, [inf, 1.0], "a"), (6, [], "b"),
            (7, [-0.1] * 5, None), (7, [-0.2] * 5, None)]
    got, codes = run(spark, rows, parts=2)
    want, books = brute(rows, 2, 16, 6, 4096)
    assert got == sorted(want, key=key) and codes.codebooks.tolist() == books and len(got) == 6
    none, codes = run(spark, [(1, None, "a")])
    assert none == [] and codes.codebooks.size == 0 and V.with_label_error(codes.rows).count() == 0
    assert run(spark, [])[0] == []
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(1, [1e15] * 4, "a")])


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, "a", b"", 5), (2, "a", b"", 6), (3, None, b"", 7), (4, None, b"", 8), (4, "b", b"", 1)], "vec_id long, label string, code binary, error long")
    assert sorted((r["vec_id"], r["label_error"]) for r in V.with_label_error(rows).collect()) == [(1, 11), (2, 11), (3, 15), (4, 1), (4, 15)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 6), st.integers(1, 4))
def test_bounded_rounds_give_what_all_distances_give(seed, count, b, width):
    """Entries that move at random, with repeats and ties: after each move the kept bounds still hold and the entry is the right one."""
    r = np.random.default_rng(seed)
    x, books = r.integers(-6, 7, (60, width)), r.integers(-6, 7, (count, width))
    state = V.assign_all(x, books, b)
    for _ in range(5):
        after = books + r.integers(-2, 3, books.shape) * (r.random((count, 1)) < 0.5)
        *state, used, needed = V.assign_bounded(x, after, V.moves(books, after), *state)
        d = ((x[:, None] - after[None]) ** 2).sum(-1)
        books = after
        assert (state[0] == d.argmin(1)).all() and needed.sum() == len(x)
        far = np.sqrt(d)
        assert (state[1] >= far[np.arange(len(x)), state[0]]).all()
        for n in range(len(x)):
            listed = {int(e): float(v) for e, v in zip(state[3][n], state[4][n], strict=True) if np.isfinite(v)}
            assert int(state[0][n]) not in listed
            assert all(far[n, e] >= listed.get(e, float(state[2][n])) for e in range(count) if e != state[0][n])


def test_shorter_lists():
    assert V.next_length(np.array([90, 5, 5, 0, 0]), 16) == 2 and V.next_length(np.array([0, 0, 0, 0, 100]), 16) == 3 and V.next_length(np.array([999, 1, 0, 0, 0, 0]), 16) == 2
    x = np.array([[0], [5]])
    entry, upper, outer, nxt, low = V.assign_all(x, np.array([[0], [2], [4], [9]]), 3)
    state = np.zeros(2, V.state_type(1, 3))
    for f, v in zip(("entry", "upper", "outer", "next", "low"), (entry, upper, outer, nxt, low), strict=True):
        state[f][:, 0] = v
    cut = V.shorter(state, 1)
    assert cut["next"].ravel().tolist() == [1, 1] and np.allclose(cut["outer"].ravel(), [4, 4]) and np.allclose(cut["low"].ravel(), [2, 3])

import random

import pytest
from pyspark.sql import functions as F

from voucherflow.llm import topk as T

SCHEMA = "vec_id long, v array<long>, extra string, shard int"


def brute(rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v]
    for q, x in good:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in good if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, T.top_k(table, F.pmod("vec_id", F.lit(50)) == 0, 5, **sizes).collect()))


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "query_rows": 3, "block": 8}, {"shard_rows": 10, "query_rows": 100, "block": 3}])
def test_equals_brute_force(spark, sizes):
    r = random.Random(4)
    centres = [[r.randint(-80, 80) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.randint(-9, 9) for c in r.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(200)]           # a vector that many rows share: ties
    assert run(spark, rows, **sizes) == brute(rows, 5)


def test_outlines_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "OUTLINES", 4)
    r = random.Random(6)
    rows = [(i, [r.randint(-50, 50) for _ in range(4)]) for i in range(500)]
    assert run(spark, rows, shard_rows=20, query_rows=4, block=5) == brute(rows, 5)


def test_awkward_rows(spark):
    rows = [(0, [1, 2]), (50, [3, -1, 4]), (None, [9, 9]), (1, None), (2, []), (3, [5]), (3, [5]), (4, [1, 1])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == [] and run(spark, [(1, [1])]) == [] and run(spark, [(0, [1])]) == []


def test_quantized(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [1.0, None]), (4, None), (5, [float("inf")]), (6, [])]
    got = {r["vec_id"]: r["v"] for r in T.quantized(spark.createDataFrame(rows, "vec_id long, e array<float>"), "e").collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, docs
from voucherflow.llm import sharding as S
from voucherflow.llm.common import checkpoint


def smallest(sizes, shards):
    """Smallest capacity by trying all."""
    def fits(c):
        n, run = 1, 0
        for s in sizes:
            if s > c:
                return False
            if run + s > c:
                n, run = n + 1, 0
            run += s
        return n <= shards
    low, high = 0, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


@pytest.mark.parametrize(("seed", "shards", "ranges"), [(1, 24, 16), (2, 5, 8), (3, 1, 4), (4, 7, 1 << 16), (5, 24, 64)])
def test_capacity_is_the_smallest(spark, seed, shards, ranges):
    r = random.Random(seed)
    # Crowded hash ranges, so that splitting goes deep, and one very large group.
    groups = {r.choice([r.randint(-2**63, 2**63 - 1), r.randint(0, 500)]): r.randint(1, 60) for _ in range(300)}
    groups[r.choice(list(groups))] = 900 * (seed % 2) + 5
    rows = checkpoint(spark.createDataFrame([(h, s) for h, s in groups.items()], "h long, size long"))
    got = S.minimax_cuts(rows, shards, ranges)
    order = [groups[h] for h in sorted(groups)]
    assert got.capacity == smallest(order, shards)
    filled = Counter(sum(h >= s for s in got.starts) for h in groups for _ in range(groups[h]))
    assert max(filled.values()) == got.capacity and max(filled) < shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 8))
def test_even_cuts_keep_the_capacity(sizes, shards):
    ends = [sum(sizes[:n + 1]) for n in range(len(sizes))]
    capacity = smallest(sizes, shards)
    starts = S._even([(n, s, True, n, 64) for n, s in enumerate(sizes)], ends, capacity, shards)
    filled = Counter(sum(n >= s for s in starts) for n, size in enumerate(sizes) for _ in range(size))
    assert max(filled.values()) <= capacity and max(filled) < shards


def test_documents(spark):
    rows = [(n, f"text {n % 400} " + "x" * (n % 37)) for n in range(1500)] + [(5000 + n, "hot") for n in range(900)]
    got = S.shard(docs(spark, rows), 24).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]].encode()), "bytes", None)
    assert len({(text[r["doc_id"]], r["shard"]) for r in got}) == len(set(text.values()))
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_awkward_rows(spark):
    got = S.shard(awkward(spark), 4).collect()
    assert len(got) == 11 and sorted(r["size"] for r in got)[:3] == [8, 8, 8]
    assert {r["text_crc32"] for r in got if r["size"] == 8} == {0}
    assert S.shard(awkward(spark).where("false"), 4).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = S.shard(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

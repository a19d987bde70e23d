"""Exact top-k inner products by block-at-a-time pruning.

Candidates are cut into blocks: ranges of an order in which like vectors stand together (by nearest of a few centres that are
fitted on a bounded sample; any order gives the same result, a good one prunes more). A vector component split by sign is a term;
a block keeps the largest and smallest value of each, so sum(max(q, 0) * largest + min(q, 0) * smallest) bounds every score in it. Blocks are
grouped in shards of `shard_rows` vectors with a forward index (ids and component rows). For a query the blocks of a shard are taken
by falling bound and scored until no bound reaches the k-th score so far.

First each query meets the shard with its highest bound, which gives a k-th score to start from; then it goes to just those other shards
whose bound still reaches that score. Queries travel in groups of `query_rows`, so a task holds one shard and one group at a time.

Equal scores go to the smaller id. A block is skipped only if its bound is lower than the k-th score, or equal with only larger ids. A row
with a null id, and a vector that is null, empty or holds a null or non-finite component, takes no part. Vectors of unequal
lengths are compared over the longer one, missing components counting as zero. Repeated ids are rows of their own; a row is never its own
candidate, nor are rows that share its id. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherflow.llm.common import checkpoint, pieces

CENTRES = 256           # at most; fitted on SAMPLE vectors
SAMPLE = 20_000
BLOCK = 64
SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
OUTLINES = 1_024        # shards whose bounds a task holds at once
STEP = 16               # blocks scored by one product
LOWEST = np.iinfo(np.int64).min


def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * sample @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def block_bounds(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each component in each block of rows."""
    at = np.arange(0, len(rows), block)
    return np.maximum.reduceat(rows, at), np.minimum.reduceat(rows, at)


def bounds_of(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T


def _better(best_s, best_i, s, i, k):
    """The k best of two lists; higher score first, then smaller id."""
    s, i = np.r_[best_s, s], np.r_[best_i, i]
    pick = np.lexsort((i, -s))[:k]
    return s[pick], i[pick]


def search_shard(qid, q, theta, ids, rows, k: int, block: int):
    """For each query its k best (score, id) in this shard that can still reach its k-th score `theta`."""
    top, low = block_bounds(rows, block)
    first_id = np.minimum.reduceat(ids, np.arange(0, len(ids), block))
    bound = bounds_of(q, top, low)
    within = np.arange(block)
    out_q, out_s, out_i = [], [], []
    for n in range(len(q)):
        order = np.lexsort((first_id, -bound[n]))
        best_s, best_i, floor = np.empty(0), np.empty(0, np.int64), theta[n]
        for at in range(0, len(order), STEP):
            some = order[at:at + STEP]
            if bound[n, some[0]] < floor:
                break
            some = some[bound[n, some] >= floor]
            if len(best_s) == k:
                some = some[(bound[n, some] > best_s[-1]) | (first_id[some] < best_i[-1])]
            pick = (some[:, None] * block + within).ravel()
            pick = pick[pick < len(ids)]
            s, i = rows[pick] @ q[n], ids[pick]
            keep = (i != qid[n]) & (s >= floor)
            if keep.any():
                best_s, best_i = _better(best_s, best_i, s[keep], i[keep], k)
                if len(best_s) == k:
                    floor = max(floor, best_s[-1])
        out_q.append(np.full(len(best_s), qid[n])), out_s.append(best_s), out_i.append(best_i)
    return np.concatenate(out_q), np.concatenate(out_s).astype(np.int64), np.concatenate(out_i)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    if len(lists) and (np.diff(at) == width).all():
        return flat[at[0]:at[-1]].reshape(-1, width).astype(np.float64)
    out = np.zeros((len(lists), width))
    for n, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[n, :b - a] = flat[a:b]
    return out


def top_k(vectors: DataFrame, is_query, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for rows (vec_id long, v array of long); `is_query` is a condition on them."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    facts = good.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.sum(F.when(is_query, 1)).alias("q")).first()
    total, width, asked = facts["n"], facts["w"] or 1, facts["q"] or 0
    share = min(1.0, SAMPLE / max(1, total))
    drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
    centres = _centres(_matrix(drawn, width), min(CENTRES, pieces(total, 4 * block)))
    shift = (centres ** 2).sum(1)

    def near(batches):
        for batch in batches:
            rows = _matrix(batch.column("v"), width)
            at = np.argmin(shift - 2 * rows @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("asks"), pa.array(at.astype(np.int32))], placed_names)

    # Shards are runs of (centre, salt); a large cluster, even of equal vectors, is cut by its salt into many shards.
    placed_names = ["vec_id", "v", "asks", "centre"]
    placed = checkpoint(good.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
                        .mapInArrow(near, "vec_id long, v array<long>, asks boolean, centre int"))
    counts = {r["centre"]: r["n"] for r in placed.groupBy("centre").agg(F.count("*").alias("n")).collect()}
    first, base = {}, 0
    for centre in sorted(counts):
        cuts = pieces(counts[centre], shard_rows)
        first[centre] = (base, cuts)
        base += cuts
    # Small neighbouring clusters share a shard until it is full.
    shard_of, now, room = {}, -1, 0
    for centre in sorted(counts):
        if counts[centre] > room:
            now, room = now + 1, shard_rows
        shard_of[centre] = now
        room -= counts[centre]
        now += first[centre][1] - 1
    spec = placed.sparkSession.createDataFrame([(c, shard_of[c], first[c][1]) for c in counts] or [(0, 0, 1)], "centre int, first int, cuts int")
    sharded = placed.join(F.broadcast(spec), "centre").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))

    def forward(group):
        group = group.sort_by([("centre", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        rows = _matrix(group.column("v").chunk(0), width)
        top, low = block_bounds(rows, len(rows))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "ids": [np.asarray(group.column("vec_id")).tobytes()],
                         "rows": [rows.astype(np.int64).tobytes()], "top": [top.astype(np.int64).tobytes()], "low": [low.astype(np.int64).tobytes()]})

    index = checkpoint(sharded.select("shard", "centre", "vec_id", "v").groupBy("shard")
                       .applyInArrow(forward, "shard int, ids binary, rows binary, top binary, low binary"))
    groups = pieces(asked, query_rows)
    queries = placed.where("asks").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"))

    if not total or not asked:
        return placed.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks = pieces(now + 1, OUTLINES)
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    outlines = index.select("shard", "top", "low", F.floor(F.col("shard") / OUTLINES).cast("int").alias("chunk"), each)
    shards = index.select("shard", "ids", "rows", each)
    spread = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    aimed = "vec_id long, v array<long>, part int, shard int, theta double"
    schema = "query_id long, score long, vec_id long"

    def aim(asks, outline):
        """In each chunk of shards, the one of highest bound for a query; or each other one that reaches its k-th score."""
        if not asks.num_rows or not outline.num_rows:
            return _empty(aimed)
        top, low = (np.stack([np.frombuffer(x, np.int64) for x in outline.column(c).to_pylist()]).astype(np.float64) for c in ("top", "low"))
        numbers = np.asarray(outline.column("shard"))
        order = np.argsort(numbers)
        bound = bounds_of(_matrix(asks.column("v").combine_chunks(), width), top[order], low[order])
        best = bound.argmax(axis=1)
        theta = _floats(asks.column("theta"))
        if asks.column("again")[0].as_py():
            reach = bound >= theta[:, None]
            reach[np.arange(len(best)), best] = False
            who, where = np.nonzero(reach)
        else:
            who, where = np.arange(len(best)), best
        taken = asks.select(["vec_id", "v", "part"]).take(pa.array(who))
        return taken.append_column("shard", pa.array(numbers[order][where])).append_column("theta", pa.array(theta[who]))

    def scored(asks, shard):
        if not asks.num_rows or not shard.num_rows:
            return _empty(schema)
        ids = np.frombuffer(shard.column("ids")[0].as_py(), np.int64)
        rows = np.frombuffer(shard.column("rows")[0].as_py(), np.int64).reshape(len(ids), width).astype(np.float64)
        q = _matrix(asks.column("v").combine_chunks(), width)
        a, s, i = search_shard(np.asarray(asks.column("vec_id")), q, _floats(asks.column("theta")), ids, rows, k, block)
        return pa.table({"query_id": a, "score": s, "vec_id": i})

    def meet(asks: DataFrame, again: bool) -> DataFrame:
        asks = asks.select("vec_id", "v", "part", "theta", F.lit(again).alias("again"), spread)
        to = asks.groupBy("chunk", "part").cogroup(outlines.groupBy("chunk", "part")).applyInArrow(aim, aimed)
        return to.groupBy("shard", "part").cogroup(shards.groupBy("shard", "part")).applyInArrow(scored, schema)

    start = checkpoint(meet(queries.withColumn("theta", F.lit(float(LOWEST))), False))
    # The k-th score so far, over all that was met: with several chunks more than k scores came back for a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    theta = start.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("theta"))
    known = queries.join(theta, queries["vec_id"] == theta["query_id"], "left").select("vec_id", "v", "part", F.coalesce("theta", F.lit(float(LOWEST))).alias("theta"))
    both = start.unionByName(meet(known, True))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floats(column) -> np.ndarray:
    return column.to_numpy().astype(np.float64)


def _empty(ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.table({f.split()[0]: pa.array([], kinds[f.split()[1]]) for f in ddl.split(", ")})


def quantized(vectors: DataFrame, column: str, scale: int = 256) -> DataFrame:
    """vec_id and v, each component x as floor(scale * x); rows with a null or non-finite component get a null v."""
    x = F.col(column)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.when(~bad, F.transform(x, lambda e: F.floor(e.cast("double") * scale))).alias("v"))

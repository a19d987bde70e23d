"""Mixing by hierarchical budgets over a domain, language, source tree, in DataFrame functions.

Every node gets its parent's budget in proportion to its weight among its siblings. A leaf can give at most its tokens times
`max_epochs`. What a node cannot use goes to its siblings that still can, in proportion to their weights, and only what
all children of a node together cannot use is left to the node's own siblings, then to its parent's. Given the capacity of each subtree this
is one water-filling for each node from the root down: children get level * weight, but no more than their capacity, with the level chosen
so that the budget is spent. The tree has one node for each domain, language and source; it is
aggregated by Spark and filled on the driver, which may hold MOST_LEAVES leaves (more is an error, not a cut).

A leaf takes whole seeded passes over its documents (epochs) and then the prefix of one more, in the order of a hash of seed, epoch and
document, that reaches its budget: the document that crosses it is still taken. The prefix comes from token totals of hash ranges; only
documents of the one range in which the budget ends are sorted, and ranges hold about `RANGE_ROWS` documents however large a leaf is.

Weights. `weights` maps a node's path, such as ("domain0",) or ("domain0", "en", "src0"), to a number; others get `default`, by their tokens to a power
`temperature` (0: equal shares, 1: by size).

Rows: null or empty texts have no tokens; they cost nothing and are taken with the epoch in whose order they lie before the end. A null
language or source is a node of its own. Repeated rows and ids are rows of their own; ties of the order are broken by doc_id and
then by text hash, and rows equal in both are taken or left together. An empty table gives no rows. Columns of the input are kept under their
names; the operator's own columns carry the prefix `mix_`.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherflow.llm.common import pieces

MOST_LEAVES = 200_000
RANGE_ROWS = 10_000


def tokens_of(text) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def fill(budget: float, capacities: dict, weights: dict) -> dict:
    """Shares of one node's children: level * weight, at most the capacity, together the budget or all capacity."""
    out, left, open_ = {}, budget, dict(capacities)
    while open_:
        total = sum(weights[k] for k in open_)
        level = left / total if total > 0 else 0.0
        full = [k for k in open_ if open_[k] <= level * weights[k]]
        if not full:
            out |= {k: level * weights[k] for k in open_}
            break
        for k in full:
            out[k] = open_.pop(k)
            left -= out[k]
    return out


def leaf_budgets(leaves: dict[tuple, int], budget: float, max_epochs: int, weights: dict | None = None, temperature: float = 0.0) -> dict[tuple, float]:
    """Tokens that each leaf (domain, language, source) should give, from the tokens that each has."""
    weights = weights or {}
    size: dict[tuple, int] = defaultdict(int)
    children: dict[tuple, set] = defaultdict(set)
    for leaf, tokens in leaves.items():
        for depth in range(len(leaf) + 1):
            size[leaf[:depth]] += tokens
            if depth:
                children[leaf[:depth - 1]].add(leaf[:depth])
    share, todo = {(): min(float(budget), float(size[()] * max_epochs))}, [()]
    while todo:
        node = todo.pop()
        kids = sorted(children.get(node, ()), key=str)
        if kids:
            weight = {k: float(weights.get(k, size[k] ** temperature if size[k] else 0.0)) for k in kids}
            share |= fill(share[node], {k: float(size[k] * max_epochs) for k in kids}, weight)
            todo += kids
    return {leaf: share[leaf] for leaf in leaves}


def with_tree(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.withColumns({"mix_domain": domain, "mix_tokens": tokens_of(F.col("text")), "mix_text": F.xxhash64("text")})


def select(docs: DataFrame, domain: Column, budget_share: float, max_epochs: int = 1, weights: dict | None = None, temperature: float = 0.0,
           seed: int = 17) -> DataFrame:
    """The chosen documents with mix_domain, mix_tokens and mix_epochs (how often each is used), for a budget of `budget_share` of all tokens."""
    leaf = ["mix_domain", "lang", "source"]
    rows = with_tree(docs, domain)
    found = rows.groupBy(*leaf).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"over {MOST_LEAVES} domain, language and source leaves")
    names = {tuple(r[c] for c in leaf): (r["tokens"], r["n"]) for r in found}
    budgets = leaf_budgets({k: v[0] for k, v in names.items()}, budget_share * sum(v[0] for v in names.values()), max_epochs, weights, temperature)
    plan = []
    for k, (tokens, n) in names.items():
        whole = min(max_epochs, int(budgets[k] / tokens + 1e-12)) if tokens else 1
        rest = math.floor(budgets[k] - whole * tokens + 0.5) if whole < max_epochs and tokens else 0
        plan.append((*k, whole, max(0, rest), pieces(n, RANGE_ROWS)))
    spark = docs.sparkSession
    kinds = dict(rows.select(*leaf).dtypes)
    table = spark.createDataFrame(plan, ", ".join(f"p_{c} {kinds[c]}" for c in leaf) + ", mix_whole int, mix_rest long, mix_ranges int")
    on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in leaf]
    order = F.xxhash64(F.lit(seed), "mix_whole", "doc_id", "mix_text")
    dealt = rows.join(F.broadcast(table), on[0] & on[1] & on[2]).drop(*(f"p_{c}" for c in leaf)).withColumn("mix_order", order)
    # Equal ranges of the order, numbered from its low end.
    dealt = dealt.withColumn("mix_range", F.floor((F.shiftright("mix_order", 32) + F.lit(1 << 31)) * F.col("mix_ranges") / F.lit(1 << 32)).cast("int"))
    sums = dealt.where("mix_rest > 0").groupBy(*leaf, "mix_range").agg(F.sum("mix_tokens").alias("t"), F.max("mix_rest").alias("rest"))
    before = Window.partitionBy(*leaf).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).where("before < rest AND before + t >= rest")
    inside = dealt.where("mix_rest > 0").select(*leaf, "mix_range", "mix_order", "doc_id", "mix_text", "mix_tokens").join(
        ends.select(*(F.col(c).alias(f"e_{c}") for c in leaf), F.col("mix_range").alias("e_range"), "before", "rest"),
        [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in leaf] + [F.col("mix_range") == F.col("e_range")])
    upto = Window.partitionBy(*leaf).orderBy("mix_order", "doc_id", "mix_text").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The first document at which the running total reaches the rest, for each leaf.
    cut = inside.withColumn("sum", F.col("before") + F.sum("mix_tokens").over(upto)).where("sum >= rest").groupBy(*leaf).agg(
        F.min(F.struct("mix_order", "doc_id", "mix_text")).alias("mix_last"))
    cut = cut.select(*(F.col(c).alias(f"c_{c}") for c in leaf), "mix_last")
    marked = dealt.join(F.broadcast(cut), [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in leaf], "left").drop(*(f"c_{c}" for c in leaf))
    extra = (F.col("mix_rest") > 0) & (F.struct("mix_order", "doc_id", "mix_text") <= F.col("mix_last"))
    used = marked.withColumn("mix_epochs", F.col("mix_whole") + F.coalesce(extra, F.lit(False)).cast("int")).where("mix_epochs > 0")
    return used.select(*docs.columns, "mix_domain", "mix_tokens", "mix_epochs")


def source_domain(domains: int = 4) -> Column:
    """A domain for each source where the table names none: a hash of the source."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(domains)).cast("string"))

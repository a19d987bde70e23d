"""Data-quality, leakage and ablation checks on labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voucherflow import schema
from voucherflow.functions.parsing import clean_field, is_filled
from voucherflow.functions.text import ID_LIKE
from voucherflow.session import ensure_checkpoint_dir

# Fixed value: column-name wording that would give the answer away.
ANSWER_WORDS = r"(?i)categor|voucher|label|\bclass|test ?case|scenario|expected (category|label|class|voucher|answer)"


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """128-bit digest of the named cells; nulls differ from empty text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]))


def data_audit(df: DataFrame, label: str, inputs: list[str], near: list[str], core: Column, group: str) -> DataFrame:
    """One-row audit: duplicates, conflicting labels, near duplicates and sentence counts.

    Each question is asked of grouped digests, so a value shared by a third of the
    rows is already one counted row when it reaches a single task.
    """
    rows = df.select(row_key(df, inputs).alias("k"), row_key(df, near).alias("near"), core.alias("core"), F.col(label).alias("label"),
                     F.col(group).alias("grp"))
    surplus = lambda key, out: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias(out), F.count_if(F.col("lo") != F.col("hi")).alias(f"{out}_conflicting"))
    per_core = rows.groupBy("core").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("classes")),
             surplus("k", "identical_inputs"), surplus("near", "near_duplicates").drop("near_duplicates_conflicting"),
             per_core.agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("lo") != F.col("hi")).alias("sentences_across_groups"))]
    from voucherflow.operators.filing import merge_single_rows
    return merge_single_rows(*parts)


def signature(columns: list[str]) -> Column:
    """Names of the filled columns, in column order."""
    return F.concat_ws(",", *[F.when(F.col(f"`{c}`").isNotNull(), c) for c in columns])


def signature_cells(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.select(signature(columns).alias("sig"), F.col(f"`{label}`").alias("label")).groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n"))


def signature_by_category(cells: DataFrame) -> DataFrame:
    """Rows and distinct signatures per category, and whether any is shared with another category."""
    labels = cells.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    both = cells.join(labels, "sig").withColumn("shared", F.col("lo") != F.col("hi"))
    return both.groupBy("label").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("signatures"), F.bool_or("shared").alias("shared"))


def leave_one_out(cells: DataFrame) -> DataFrame:
    """Rows whose label equals the majority of the other rows with the same signature (ties to the first name).

    A row's own vote only matters for the most frequent label, so the answer needs
    the two largest counts of each signature, never the rows themselves.
    """
    w = W.partitionBy("sig").orderBy(F.col("n").desc(), "label")
    top = cells.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pair = top.groupBy("sig").agg(*[F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("n", "label")])
    rest = F.coalesce(F.col("n2"), F.lit(0))
    own = F.col("n1") - 1
    wins = (own > 0) & ((own > rest) | ((own == rest) & (F.col("label1") < F.col("label2"))))
    return pair.agg(F.count(F.lit(1)).alias("distinct_signatures"), F.coalesce(F.sum(F.when(wins, F.col("n1"))), F.lit(0)).cast("bigint").alias("loo_correct"))


def identifier_prefixes(df: DataFrame, label: str) -> DataFrame:
    """(identifier column, prefix) -> categories it occurs with."""
    names = [c for c in schema.OWN_ID_COLUMNS + schema.REFERENCE_ID_COLUMNS if c in df.columns]
    cells = F.array(*[F.when(is_filled(F.col(f"`{c}`")), F.struct(F.lit(c).alias("id_column"), clean_field(F.col(f"`{c}`")).alias("v"))) for c in names])
    tall = df.select(F.explode(cells).alias("e"), F.col(f"`{label}`").alias("label")).filter("e IS NOT NULL")
    pairs = tall.select("e.id_column", F.regexp_extract("e.v", "^[A-Z-]*[A-Z]", 0).alias("prefix"), "label")
    counts = pairs.groupBy("id_column", "prefix", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id_column", "prefix").agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("categories"))


def id_like_columns(df: DataFrame, skip: set[str]) -> DataFrame:
    """Other columns holding values that look like document codes, with counts."""
    names = [c for c in df.columns if c not in skip]
    counts = df.agg(*[F.count_if(clean_field(F.col(f"`{c}`")).rlike(ID_LIKE)).alias(f"c{i}") for i, c in enumerate(names)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_rows")) for i, c in enumerate(names)])).alias("e")) \
        .select("e.*").filter("n_rows > 0")


def mismatches(base: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose outcome differs between two runs."""
    left, right = base.select(key, F.col(column).alias("a")), other.select(key, F.col(column).alias("b"))
    return left.join(right, key, "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count(F.lit(1)).alias("n_rows"))


def rows_holding_values(texts: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """Text rows that contain any of a list of identifier values, as a token join.

    Distinct tokens per row are matched on equality, so neither side is compared pairwise.
    """
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[\w/-]+"), 0))).alias("token"))
    return tokens.join(values.select(F.col("value").alias("token")).distinct(), "token", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b), by alternating large and small star steps.

    The component is named after its smallest node. Neighbour minima are partial
    aggregates; each round is cut with a checkpoint in the shared folder. It runs until no edge changes.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    links = flat.filter("a <> b").distinct().checkpoint()
    last = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before their join, so that it has a shuffle on either side and adaptive execution can split a hub's rows.
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = large.checkpoint()
        mins = large.groupBy("b").agg(F.min("a").alias("m")).checkpoint()
        small = large.join(mins, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")) \
            .select("e.*").filter("a <> b").distinct()
        links = small.checkpoint()
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    named = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shared_value_components(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Component of every row linked through any shared value.

    Rows are first reduced to distinct value combinations; only those become edges.
    """
    tagged = {n: F.concat(F.lit(f"{n}:"), F.coalesce(c.cast("string"), F.lit(""))) for n, c in values.items()}
    names = list(tagged)
    rows = df.select(key, *[c.alias(n) for n, c in tagged.items()])
    combos = rows.select(*names).distinct()
    edges = reduce(lambda x, y: x.union(y), [combos.select(F.col(names[0]).alias("a"), F.col(n).alias("b")) for n in names[1:]])
    found = connected_components(edges)
    return rows.join(found, rows[names[0]] == found["node"]).select(key, "component")

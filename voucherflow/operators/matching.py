"""Book to portal matching, return-style tables and agreement statistics promised by the documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("gstin", "number", "doc_date")


def match_portal(books: DataFrame, portal: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Full outer match on GSTIN, number and date; values compared within a tolerance.

    Either side may repeat a key, so each key is first summed with a count. A row without a GSTIN, number or date has no identity: it is
    matched with nothing, and such rows are summed by what they do have, with a status of their own.
    """
    side = lambda df, name: df.groupBy(*KEY).agg(F.sum("value").alias(f"{name}_value"), F.count(F.lit(1)).alias(f"{name}_rows"))
    c = F.col
    whole = (c("gstin") != "") & (c("number") != "") & c("doc_date").isNotNull()
    named = F.coalesce(whole, F.lit(False))
    both = side(books.where(named), "book").join(side(portal.where(named), "portal"), list(KEY), "full")
    nameless = side(books.where(~named), "book").unionByName(side(portal.where(~named), "portal"), allowMissingColumns=True)
    status = F.when(c("portal_rows").isNull(), "MISSING_IN_PORTAL").when(c("book_rows").isNull(), "MISSING_IN_BOOKS") \
        .when(F.abs(c("book_value") - c("portal_value")) <= F.lit(tolerance), "MATCHED").otherwise("VALUE_MISMATCH")
    return both.withColumn("match_status", status).unionByName(nameless.withColumn("match_status", F.lit("NO_IDENTITY")))


def composite_hash(gstin: Column, number: Column, taxable: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (gstin, number, taxable)]))


def repeated_across_periods(df: DataFrame) -> DataFrame:
    """Composite keys seen in more than one period (partial counts, no row is gathered)."""
    return df.groupBy("dup_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period")) \
        .filter("first_period <> last_period")


def agreement_split(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two models agree become pseudo-labels; the rest go to the hard queue."""
    same = F.col(a) == F.col(b)
    return df.withColumn("queue", F.when(same, "pseudo_label").otherwise("hard_negative")).withColumn("pseudo_label", F.when(same, F.col(a)))


def poisson_edges() -> list[float]:
    """Where the Poisson(1) distribution steps up, as far as a 32-bit draw can tell."""
    edges, p, edge, k = [], math.exp(-1.0), 0.0, 0
    while edge + p <= 1.0 - 2.0 ** -32:
        edge += p
        edges.append(edge)
        k += 1
        p /= k
    return edges


def bootstrap_clusters(df: DataFrame, cluster: str, hit: Column, rounds: int) -> DataFrame:
    """Accuracy per round, resampling whole clusters with a Poisson(1) weight drawn from a hash.

    Cluster totals are formed once; rounds multiply that small table, not the rows.
    """
    totals = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    draws = totals.select(cluster, "n", "hits", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(cluster).cast("string"), F.col("round").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = F.lit(0)
    for edge in poisson_edges():
        weight = weight + F.when(u >= edge, 1).otherwise(0)
    return draws.withColumn("w", weight).groupBy("round").agg(
        (F.sum(F.col("w") * F.col("hits")) / F.sum(F.col("w") * F.col("n"))).alias("accuracy"))


def return_tables(calcs: DataFrame, matched: DataFrame) -> DataFrame:
    """Return-style lines 3.1 and 4 from the figures, with the portal's value beside the credit line."""
    from voucherflow.functions.literals import fixed_table
    lines = fixed_table(calcs.sparkSession, "line name", [
        ("3.1(a) outward taxable value", "outward_taxable_value"), ("3.1(a) outward tax", "outward_total_tax"),
        ("3.1(c) zero tax value", "zero_tax_value"), ("4(A) credit with evidence", "itc_tax_with_basic_evidence"),
        ("4(B) credit reversed by debit notes", "debit_notes_total_tax"), ("4(C) net credit", "potential_itc_after_debit_notes")])
    seen = matched.agg(F.sum("portal_value").cast("decimal(28,2)").alias("v")).select(F.lit("itc_tax_with_basic_evidence").alias("name"), F.col("v").alias("portal_value"))
    value = F.col("value").cast("decimal(28,2)")
    return lines.join(calcs.select("name", "value", "status"), "name").join(F.broadcast(seen), "name", "left").select(
        "line", "value", "status", F.col("portal_value").cast("string").alias("portal_value"), (value - F.col("portal_value")).cast("decimal(28,2)").cast("string").alias("variance"))

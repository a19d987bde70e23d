"""Parquet tables and the accounting tables derived from them, row by row, at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherflow.functions.gstin import check_digit
from voucherflow.operators.features import once


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core; inputs with enough splits pass untouched, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dec(c: Column | str, precision: int = 18, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({precision},{scale})")


# Category by order key modulo 20.
CATEGORY_BY_SLOT = (
    ("Sales",) * 7 + ("Purchase",) * 5 + ("Export", "Import", "Sales Return / Credit Note",
                                          "Purchase Return / Debit Note", "Expense", "Receipt", "Payment", "Journal")
)
RATE_BY_SLOT = (0, 5, 12, 18, 28, 17)


def pick(slot: Column, values: tuple) -> Column:
    """Value at a zero-based slot, as an indexed literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), slot.cast("int") + 1)


def category_at(k: Column) -> Column:
    return pick(k % 20, CATEGORY_BY_SLOT)


def with_party_gstin(df: DataFrame, k: Column, custkey: Column) -> DataFrame:
    """Add `party_gstin` with known defects: missing, bad format, bad check digit."""
    df = once(df, {"stem": F.concat(F.when(k % 5 == 0, "29").otherwise("27"), F.lit("AAACB"),
                                    F.lpad((custkey % 10000).cast("string"), 4, "0"), F.lit("C1Z"))})
    df = once(df, {"digit": check_digit(F.col("stem"))})
    wrong = F.when(F.col("digit") == "0", "1").otherwise("0")
    tail = F.when(k % 19 == 0, "!").when(k % 67 == 0, wrong).otherwise(F.col("digit"))
    return df.withColumn("party_gstin", F.when(k % 17 != 0, F.concat("stem", tail))).drop("stem", "digit")


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical accounting rows, one per order, with a category and seeded defects."""
    return books_from(spread(table(spark, folder, "orders")))


def books_from(orders: DataFrame) -> DataFrame:
    """The same rows from any orders table, batch or stream."""
    o = orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), dec("o_totalprice").alias("amt"),
        F.col("o_orderdate").cast("date").alias("d"))
    k, amt = F.col("k"), F.col("amt")
    r0 = pick(k % 6, RATE_BY_SLOT).cast("decimal(9,2)")
    t0 = dec(F.round(amt * r0 * F.lit("0.01").cast("decimal(3,2)"), 2))
    o = o.withColumn("r0", r0).withColumn("t", t0).withColumn("h", dec(F.round(t0 * F.lit("0.5").cast("decimal(2,1)"), 2)))
    t, h = F.col("t"), F.col("h")
    far = k % 5 == 0
    no_split = (k % 7 == 0) | (far & (k % 41 != 0))
    own = F.col("category").isin("Sales", "Export", "Sales Return / Credit Note")
    cash = F.col("category").isin("Receipt", "Payment")
    five, fifty, nine, ten = (F.lit(n).cast("decimal(5,2)") for n in (5, 50, 9, 10))
    out = with_party_gstin(o.withColumn("category", category_at(k)), k, F.col("c"))
    rate = F.when(k % 13 != 0, F.col("r0"))
    total = F.when(k % 47 == 0, amt + t + fifty).otherwise(amt + t)
    ledger_row = k % 19 == 0
    taxable = F.when(k % 31 != 0, amt)
    closing = amt + F.coalesce(taxable, dec(F.lit(0))) - t + F.when(k % 133 == 0, dec(F.lit(1))).otherwise(dec(F.lit(0)))
    return out.select(
        k.alias("ord"),
        F.concat(F.lit("orders!R"), (k + 2).cast("string")).alias("source_ref"),
        "category",
        (k % 23 == 0).alias("ambiguous"),
        ((k % 100).cast("double") / 100).alias("score"),
        F.when(k % 29 == 0, "USD").when(k % 4 != 0, "INR").alias("currency"),
        taxable.alias("taxable_value"),
        rate.alias("gst_rate"),
        F.when(k % 10 == 0, F.concat(F.col("r0").cast("int").cast("string"), F.lit(".0")))
        .when(k % 13 != 0, F.col("r0").cast("int").cast("string")).alias("rate_hint"),
        dec(F.when(~no_split, F.when(k % 37 == 0, h + five).otherwise(h)), 19).alias("cgst"),
        dec(F.when(~no_split, t - h), 19).alias("sgst"),
        dec(F.when((k % 7 != 0) & far, t), 19).alias("igst"),
        dec(F.when(k % 71 == 0, ten), 19).alias("cess"),
        dec(F.when(k % 21 == 0, None).when(k % 7 == 0, t).when(k % 43 == 0, t + nine).when(k % 3 == 0, t), 19)
        .alias("total_tax"),
        dec(F.when(k % 11 != 0, total), 20).alias("total_amount"),
        F.when(cash, amt).alias("amount"),
        F.when(k % 59 == 0, None).when(k % 53 == 0, F.concat(F.lit("INV-DUP"), (k % 4).cast("string")))
        .otherwise(F.concat(F.lit("INV-"), k.cast("string"))).alias("invoice_number"),
        F.when(k % 61 != 0, F.col("d")).alias("invoice_date"),
        F.lit(None).cast("string").alias("supplier_gstin"),
        F.lit(None).cast("string").alias("recipient_gstin"),
        "party_gstin",
        F.when(~own, F.concat(F.lit("Party "), F.col("c").cast("string"))).alias("supplier_name"),
        F.when(own, F.concat(F.lit("Party "), F.col("c").cast("string"))).alias("customer_name"),
        F.when((k % 20).isin(14, 15) & (k % 3 != 0), F.concat(F.lit("INV-"), (k - 1).cast("string")))
        .alias("original_invoice_ref"),
        F.lit(None).cast("string").alias("place_of_supply"),
        F.lit(None).cast("string").alias("hsn_sac"),
        F.when(ledger_row, F.concat(F.lit("L"), (k % 7).cast("string"))).alias("ledger"),
        F.when(ledger_row, amt).alias("opening_balance"),
        F.when(ledger_row & (k % 3 != 0), dec(closing, 22)).alias("closing_balance"),
        F.when(ledger_row, taxable).alias("debit"),
        F.when(ledger_row, t).alias("credit"),
    ).withColumn("gst_rate_text", F.when(F.col("gst_rate").isNotNull(), F.col("rate_hint"))).drop("rate_hint")


BUSINESS_GSTIN = "27AAACB1234C1Z"   # completed with its check digit below


def business_gstin(spark: SparkSession | None = None) -> str:
    """The sample business: state 27, PAN AAACB1234C."""
    chars = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = [chars.index(ch) * (1 + i % 2) for i, ch in enumerate(BUSINESS_GSTIN)]
    return BUSINESS_GSTIN + chars[-sum(p // 36 + p % 36 for p in places) % 36]

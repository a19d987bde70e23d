"""Voucher fingerprints: certify once, look up, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def voucher_hash(*cols: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def certify(new: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """First row per number (by time, then row order), minus numbers already registered.

    min_by over a struct keeps one row per number with partial aggregation.
    """
    first = new.groupBy("certificate_number").agg(
        F.min(F.struct("issued_at", "ord", "voucher_hash")).alias("m")).select(
        "certificate_number", F.col("m.voucher_hash").alias("voucher_hash"), F.col("m.issued_at").alias("issued_at"))
    return first if registry is None else first.join(registry.select("certificate_number"), "certificate_number", "left_anti")


def rejected(new: DataFrame, accepted: DataFrame) -> DataFrame:
    """How many requests each number lost to an earlier certificate."""
    counts = new.groupBy("certificate_number").agg(F.count(F.lit(1)).alias("requests"))
    kept = accepted.select("certificate_number", F.lit(1).alias("kept"))
    return counts.join(kept, "certificate_number", "left").select(
        "certificate_number", (F.col("requests") - F.coalesce("kept", F.lit(0))).alias("rejected")).filter("rejected > 0")


def lookup(numbers: DataFrame, registry: DataFrame) -> DataFrame:
    hit = registry.select("certificate_number", "voucher_hash", "issued_at", F.lit(True).alias("found"))
    return numbers.join(hit, "certificate_number", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def verify(vouchers: DataFrame, registry: DataFrame) -> DataFrame:
    """Recomputed hash against the stored one; null when the number is unknown."""
    stored = registry.select("certificate_number", F.col("voucher_hash").alias("stored"))
    return vouchers.join(stored, "certificate_number", "left").withColumn("matches", F.col("voucher_hash") == F.col("stored"))

"""Tables out, never over an existing result."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def refuse_existing(spark: SparkSession, paths: list[str]) -> None:
    """Check every target before anything is written."""
    found = [p for p in paths if _exists(spark, p)]
    if found:
        raise FileExistsError(f"refusing to overwrite: {', '.join(found)}")


def run_folder(root: str, stem: str) -> str:
    """A fresh stamped folder name for one run."""
    return f"{root}/{stem}_{time.strftime('%Y%m%d-%H%M%S')}_{uuid.uuid4().hex[:8]}"


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_report(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Several result tables of one run; all targets are checked first."""
    paths = {name: f"{root}/{name}" for name in tables}
    first = next(iter(tables.values()))
    refuse_existing(first.sparkSession, list(paths.values()))
    for name, df in tables.items():
        write_once(df, paths[name], fmt)
    return paths


EXPORT_NAMES = {   # fixed values: column titles of the exported table
    "invoice_number": "Invoice No", "invoice_date": "Date", "party_name": "Party Name", "amount": "Amount",
    "category": "Predicted Voucher", "score": "Confidence (%)", "status": "Status", "gstin": "GSTIN",
    "taxable_value": "Taxable Value", "tax": "GST Amount", "payment_mode": "Payment Mode", "description": "Description",
    "source_file": "Source File",
}


def export_rows(df: DataFrame) -> DataFrame:
    """Classified rows under the titles users see."""
    names = [n for n in EXPORT_NAMES if n in df.columns]
    return df.select(*[F.col(n).alias(EXPORT_NAMES[n]) for n in names])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row hashes summed in 64-bit halves, so no row is gathered or sorted."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    half = lambda start: F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(half(1)).cast("string").alias("sum_head"),
                  F.sum(half(13)).cast("string").alias("sum_next"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))

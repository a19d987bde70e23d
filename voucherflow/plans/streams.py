"""Streaming jobs run to completion over the given tables, so their results can be checked like any query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voucherflow.config import Rules
from voucherflow.plans import gst  # noqa: F401  (registers the tables the SQL below reads)
from voucherflow.plans.ctes import with_
from voucherflow.plans.registry import query
from voucherflow.session import ensure_checkpoint_dir
from voucherflow.sources import sinks
from voucherflow.sources import tables as T
from voucherflow.streaming import jobs

RULES = Rules()


def _run_folder(spark) -> str:
    """A fresh run folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


@query("str_01", with_("found", "SELECT source_ref, variant AS finding_id FROM found WHERE variant < 25"))
def str_01(spark, sf):
    """Row-local checks over orders read as a stream; equals the batch findings."""
    base = _run_folder(spark)
    orders = spark.readStream.schema(T.table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    jobs.run_checks(T.books_from(orders), f"{base}/out", f"{base}/ckpt", RULES, T.business_gstin()).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("source_ref", "finding_id")


@query("str_02", "SELECT CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, event_type, count(*) AS n_rows FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def str_02(spark, sf):
    """Daily counts of several files in order of time: closed days, the days still open when the input ends, and the rows that came late, added up."""
    base = _run_folder(spark)
    given = T.table(spark, sf, "events")
    given.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    jobs.run_closed_days(jobs.file_stream(spark, f"{base}/in", given), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return jobs.closed_days(spark, f"{base}/out", ended=True).groupBy("day", "event_type").agg(F.sum("n_rows").alias("n_rows"))


@query("str_03", with_("numbered", "SELECT grp, party, number, count(*) AS n FROM numbered GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def str_03(spark, sf):
    """Duplicate numbers across batches of one file each, upserted per batch; equals the batch counts."""
    base = _run_folder(spark)
    given = T.table(spark, sf, "orders")
    given.repartition(4, "o_orderkey").write.parquet(f"{base}/in")
    orders = jobs.file_stream(spark, f"{base}/in", given)
    # A batch is one file, which one task would read and turn into keys; its rows are dealt to all cores first.
    spread = orders.repartition(spark.sparkContext.defaultParallelism)
    rows = jobs.numbered_stream(T.books_from(spread), RULES, T.business_gstin())

    def merge(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    jobs.run_duplicates(rows, merge, f"{base}/ckpt").awaitTermination()
    seen = spark.read.schema("`group` string, party string, number string, n bigint, batch_id bigint").option("basePath", f"{base}/out").parquet(f"{base}/out")
    return seen.groupBy(F.col("group").alias("grp"), "party", "number").agg(F.max_by("n", "batch_id").alias("n"))



@query("snk_02", with_("books", "SELECT category, count(*) AS n_rows, true AS second_write_refused FROM books GROUP BY 1"))
def snk_02(spark, sf):
    """Results go to a fresh run folder; writing the same target again is refused before anything is written."""
    rows = T.books(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
    target = sinks.write_once(rows, sinks.run_folder(ensure_checkpoint_dir(spark), "categories"))
    try:
        sinks.refuse_existing(spark, [target])
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.parquet(target).withColumn("second_write_refused", F.lit(refused))

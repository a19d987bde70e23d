"""Streaming twins of row-local checks, daily counts and duplicate numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voucherflow.config import Rules
from voucherflow.operators import features as FE
from voucherflow.operators import validation as V


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, with a fixed schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def checked_rows(stream: DataFrame, rules: Rules = Rules(), business_gstin: str | None = None) -> DataFrame:
    """Row-local findings of a stream of canonical rows: stateless, so batch and stream share one plan."""
    return V.row_checks(FE.features(stream, rules, business_gstin), rules)


def run_checks(stream: DataFrame, out: str, checkpoint: str, rules: Rules = Rules(), business_gstin: str | None = None) -> StreamingQuery:
    """Append findings; the file sink and the checkpoint give each batch exactly once, also after an executor or driver loss."""
    return checked_rows(stream, rules, business_gstin).writeStream.format("parquet").outputMode("append") \
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Rows per day and event type; a day closes once the watermark passes its end."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness) \
        .groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.col("window.start").cast("date").alias("day"), "event_type", "n_rows")


def run_daily_counts(stream: DataFrame, out: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    return daily_counts(stream, lateness).writeStream.format("parquet").outputMode("append") \
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Batches:
    """Tables that a stream's batches leave, one folder a batch; a batch that is run again writes its folder anew, so each counts once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def before(self, batch_id: int) -> DataFrame:
        """All rows of the batches before this one."""
        return self.all().filter(F.col("batch") < batch_id)

    def at(self, batch_id: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch_id}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schema).parquet(path.toString()) if there else self.spark.createDataFrame([], self.schema)

    def all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        schema = f"{self.schema}, batch bigint"
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(self.folder) if there else self.spark.createDataFrame([], schema)


DAYS = "day date, event_type string, n_rows bigint, late boolean, newest timestamp"


def run_closed_days(stream: DataFrame, out: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Counts of each batch by day and type, marked late where the day had closed before: its end lies `lateness` or more before the newest row of the batches before.

    A row with a null time has no day and is left out. Read the result with `closed_days`; late rows come out beside it, so no row is lost."""
    kept = _Batches(stream.sparkSession, out, DAYS)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = F.broadcast(_Batches(spark, out, DAYS).before(batch_id).agg(F.max("newest").alias("seen")))       # one row
        rows = batch.withColumn("at", F.col("ts").cast("timestamp")).filter("at IS NOT NULL")
        counts = rows.groupBy(F.to_date("at").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.max("at").alias("newest")).join(seen)
        late = F.coalesce(F.date_add("day", 1).cast("timestamp") <= F.col("seen") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        kept.write(counts.select("day", "event_type", "n_rows", late.alias("late"), "newest"), batch_id)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_days(spark: SparkSession, out: str, lateness: str = "1 day", ended: bool = False) -> DataFrame:
    """(day, event_type, n_rows, late): rows that came in time, of days that have closed (of all days once the stream has `ended`), and those that came late."""
    rows = _Batches(spark, out, DAYS).all()
    newest = F.broadcast(rows.agg(F.max("newest").alias("seen")))       # one row
    sums = rows.groupBy("day", "event_type", "late").agg(F.sum("n_rows").alias("n_rows"))
    if not ended:
        sums = sums.join(newest).filter(F.date_add("day", 1).cast("timestamp") <= F.col("seen") - F.expr(f"INTERVAL {lateness}"))
    return sums.select("day", "event_type", "n_rows", "late")


def first_numbers(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """First row of every (group, party, number) within the watermark; later repeats are dropped."""
    return stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["group", "party", "number"])


def numbered_stream(stream: DataFrame, rules: Rules = Rules(), business_gstin: str | None = None) -> DataFrame:
    """Duplicate keys of a canonical stream; event time is the document date, or the time of arrival where a document has none."""
    rows = V.numbered_rows(FE.features(stream, rules, business_gstin))
    return rows.withColumn("at", F.coalesce(F.col("invoice_date").cast("timestamp"), F.current_timestamp()))


def duplicate_counts(stream: DataFrame) -> DataFrame:
    """Running count per duplicate key; state holds one number per key, whatever the key's size.

    State lives as long as the query: a number may come back after years, and dropping its key would lose that duplicate. Where only
    repeats within a time matter, `run_recent_duplicates` keeps keys for that time and no longer.
    """
    return stream.groupBy("group", "party", "number").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def run_duplicates(stream: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """Emit every key whose count changed and exceeds one; `merge(df, batch_id)` upserts them by key, so replays are harmless."""
    def each(batch: DataFrame, batch_id: int) -> None:
        merge(batch.filter("n > 1"), batch_id)

    return duplicate_counts(stream).writeStream.outputMode("update").foreachBatch(each) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RECENT = "`group` string, party string, number string, n bigint, first_ord bigint, last_at timestamp"


def run_recent_duplicates(stream: DataFrame, history: str, checkpoint: str, lifetime: str = "365 days") -> StreamingQuery:
    """Counts of numbers that came within `lifetime` of their last occurrence, kept as a table of the keys that are still alive.

    A batch meets the history that the batch before it left: keys are added up, and one whose last occurrence lies more than `lifetime` before the newest row seen is
    left out, so the history holds no more keys than that time brings. A number that comes back later starts anew. Each batch writes its history and its
    duplicates under its own number, so a batch that is run again gives the same. Read the duplicates with `recent_duplicates`."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy("group", "party", "number").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("at").alias("last_at"), F.min("at").alias("from_at"))
        old = _Batches(spark, f"{history}/alive", RECENT).at(batch_id - 1)
        newest = F.broadcast(old.select("last_at").unionByName(now.select("last_at")).agg(F.max("last_at").alias("newest")))      # one row
        o = old.select(*[F.col(c).alias(f"o_{c}") for c in ("group", "party", "number", "n", "first_ord", "last_at")])
        same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in ("group", "party", "number")]
        both = now.join(o, same[0] & same[1] & same[2], "full")
        follows = F.col("o_n").isNotNull() & (F.col("n").isNull() | (F.col("from_at") <= F.col("o_last_at") + F.expr(f"INTERVAL {lifetime}")))
        merged = both.select(
            *[F.coalesce(c, f"o_{c}").alias(c) for c in ("group", "party", "number")],
            (F.coalesce("n", F.lit(0)) + F.when(follows, F.col("o_n")).otherwise(0)).alias("n"),
            F.when(follows, F.least("first_ord", "o_first_ord")).otherwise(F.col("first_ord")).alias("first_ord"),
            F.greatest("last_at", "o_last_at").alias("last_at"), F.col("n").isNotNull().alias("touched")).join(newest)
        alive = merged.filter(F.col("last_at") >= F.col("newest") - F.expr(f"INTERVAL {lifetime}"))
        _Batches(spark, f"{history}/found", RECENT).write(merged.filter("touched AND n > 1").drop("touched", "newest"), batch_id)
        _Batches(spark, f"{history}/alive", RECENT).write(alive.drop("touched", "newest"), batch_id)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_duplicates(spark: SparkSession, history: str) -> DataFrame:
    """The last state of every number that was found more than once."""
    rows = _Batches(spark, f"{history}/found", RECENT).all()
    last = rows.groupBy("group", "party", "number").agg(F.max_by(F.struct("n", "first_ord", "last_at"), "batch").alias("x"))
    return last.select("group", "party", "number", "x.n", "x.first_ord", "x.last_at")

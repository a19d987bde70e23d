"""Queries behind the console: search, queues, distributions, daily counts and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REVIEW_BELOW = 0.5   # fixed value: rows scored below this, or not at all, wait for review
PAGE, KEPT_ROWS, KEPT_UPLOADS = 100, 5000, 50


def needs_review(score: str = "score") -> Column:
    return F.col(score).isNull() | (F.col(score) < REVIEW_BELOW)


def search(df: DataFrame, text: str = "", category: str = "all", review_only: bool = False) -> DataFrame:
    """Case-insensitive substring over category, reference, file and every record value."""
    out = df.filter(needs_review()) if review_only else df
    if category != "all":
        out = out.filter(F.col("category") == category)
    q = text.strip().lower()
    if not q:
        return out
    hay = F.lower(F.concat_ws("\n", "category", "source_ref", "file_name", F.map_values("record")))
    if "\n" in q:
        values = F.concat(F.array("category", "source_ref", F.coalesce("file_name", F.lit(""))), F.map_values("record"))
        return out.filter(F.exists(values, lambda v: F.contains(F.lower(v), F.lit(q))))
    return out.filter(F.contains(hay, F.lit(q)))


def result_filter(df: DataFrame, tab: str = "all", voucher: str = "all", text: str = "") -> DataFrame:
    """Status tab, voucher type and search over four columns."""
    out = df
    if tab != "all":
        out = out.filter(F.col("status") == {"high": "High", "review": "Review", "exception": "Exception"}[tab])
    if voucher != "all":
        out = out.filter(F.col("voucher") == voucher)
    if text:
        q = F.lit(text.lower())
        hits = [F.contains(F.lower(c), q) for c in ("invoice_no", "party", "amount", "voucher")]
        out = out.filter(hits[0] | hits[1] | hits[2] | hits[3])
    return out


def fold_slices(counts: DataFrame, kept: int = 5) -> DataFrame:
    """Largest categories, the rest as 'Other'. The input is one row per category."""
    ranked = counts.withColumn("rn", F.row_number().over(W.orderBy(F.col("n").desc(), "category")))
    slot = F.when(F.col("rn") <= kept, F.col("category")).otherwise("Other")
    return ranked.groupBy(slot.alias("label")).agg(F.sum("n").alias("value"))


def newest(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A page of rows, most recent first."""
    page = df.orderBy(F.col("created_at").desc(), F.col("id"))
    return (page.offset(offset) if offset else page).limit(n)


def retained(df: DataFrame, kept: int = KEPT_ROWS) -> DataFrame:
    """The newest rows that the store keeps; each task passes on as many at most."""
    return newest(df, kept)


def sorted_store(df: DataFrame, uri: str) -> DataFrame:
    """The rows written in ranges of their order, newest first, so that a page reads only the files that its key range meets."""
    order = [F.col("created_at").desc(), F.col("id")]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


def page_after(df: DataFrame, n: int, last: tuple | None = None) -> DataFrame:
    """The next `n` rows, most recent first, after the key (created_at, id) that the page before ended with; the first page without one.

    No row of an earlier page is counted or sorted: over a sorted store the filter skips their files, however deep the page."""
    if last is not None:
        at, id_ = F.lit(last[0]), F.lit(last[1])
        df = df.filter((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") > id_)))
    return newest(df, n)


def last_key(page: DataFrame) -> tuple | None:
    """The key that a page ends with: one row."""
    row = page.orderBy("created_at", F.col("id").desc()).select("created_at", "id").first()
    return (row["created_at"], row["id"]) if row else None


def per_day(df: DataFrame, last_day: str, days: int = 7) -> DataFrame:
    """Rows per day with zero fill, ending on `last_day`."""
    end = F.lit(last_day).cast("date")
    wanted = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = df.filter(F.col("created_at").cast("date").between(F.date_sub(end, days - 1), end)) \
        .groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_rows"))


def key_figures(df: DataFrame, today: str) -> DataFrame:
    """Totals of the console in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("created_at").cast("date") == F.lit(today).cast("date")).alias("today"),
                  F.count_if(needs_review()).alias("pending_review"), F.avg("score").alias("mean_score"),
                  F.countDistinct("file_name").alias("files"))


def finding_figures(groups: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocking discrepancy groups, and rows with any finding that is not INFO."""
    blocking = groups.agg(F.count_if(F.col("severity").isin("HIGH", "MEDIUM")).alias("finding_groups"))
    touched = rows.agg(F.count_if(F.exists("findings", lambda x: x["severity"] != "INFO")).alias("rows_with_findings"))
    return blocking, touched


def upload_log(df: DataFrame, kept: int = KEPT_UPLOADS) -> DataFrame:
    """Files with row counts and last time, newest first."""
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.max("created_at").alias("last_at")) \
        .orderBy(F.col("last_at").desc(), "file_name").limit(kept)


def batch_card(df: DataFrame) -> DataFrame:
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("category").alias("categories"),
                                       F.count_if(needs_review()).alias("to_review"))


def observed_columns(df: DataFrame, kept: int = 5) -> DataFrame:
    """First record keys seen, by row position then key position."""
    seen = df.select("id", F.posexplode(F.map_keys("record")).alias("pos", "column_name"))
    first = seen.groupBy("column_name").agg(F.min(F.struct("id", "pos")).alias("first_seen"))
    return first.orderBy("first_seen").limit(kept)


def share_by_status(df: DataFrame, status: str) -> DataFrame:
    """Rows per status with a percentage to one decimal; the total comes from the counts, not from a second scan."""
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("n_rows") / total, 1))

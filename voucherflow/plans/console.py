"""Queries over console rows, certificates and plain relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voucherflow import schema
from voucherflow.functions.literals import fixed_table
from voucherflow.operators import certificates as CE
from voucherflow.operators import console as K
from voucherflow.operators.ranking import overall_rank
from voucherflow.plans import gst, normalization
from voucherflow.plans.ctes import category_sql, cte, lits, sql_list, with_
from voucherflow.plans.registry import query
from voucherflow.sources import tables as T
from voucherflow.sources.wide import WIDE_COLUMNS, wide_vouchers


def console_rows(spark, sf):
    e, i = T.table(spark, sf, "events"), F.col("event_id")
    return e.select(
        i.alias("id"), F.concat(F.lit("events!R"), (i + 2).cast("string")).alias("source_ref"),
        F.concat(F.lit("file"), (F.col("user_id") % 5).cast("string")).alias("file_name"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("category"),
        F.when(i % 10 != 0, F.least(F.col("value") / 200, F.lit(1.0))).alias("score"),
        F.create_map(F.lit("Amount"), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("Props"), F.col("props")).alias("record"),
        F.when(i % 10 == 0, "Exception").when(F.col("value") < 100, "Review").otherwise("High").alias("status"))


cte("console", (), """
SELECT event_id AS id, 'events!R' || CAST(event_id + 2 AS VARCHAR) AS source_ref, 'file' || CAST(user_id % 5 AS VARCHAR) AS file_name, ts AS created_at,
 event_type AS category, CASE WHEN event_id % 10 <> 0 THEN least(value / 200, 1.0::DOUBLE) END AS score,
 CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount, props,
 CASE WHEN event_id % 10 = 0 THEN 'Exception' WHEN value < 100 THEN 'Review' ELSE 'High' END AS status FROM events""")
_REVIEW = "(score IS NULL OR score < 0.5)"


@query("flt_01", with_("console", f"""
SELECT id, source_ref FROM console WHERE {_REVIEW} AND category = 'click' AND (contains(lower(category), '7') OR contains(lower(source_ref), '7')
 OR contains(file_name, '7') OR contains(amount, '7') OR contains(lower(props), '7'))"""))
def flt_01(spark, sf):
    return K.search(console_rows(spark, sf), " 7 ", "click", True).select("id", "source_ref")


@query("flt_02", with_("console", """
SELECT id, status, category AS voucher FROM console WHERE status = 'Review' AND category = 'view'
 AND (contains(lower(source_ref), '12') OR contains(file_name, '12') OR contains(amount, '12') OR contains(category, '12'))"""))
def flt_02(spark, sf):
    rows = console_rows(spark, sf).select("id", "status", F.col("source_ref").alias("invoice_no"), F.col("file_name").alias("party"),
                                          F.col("record")["Amount"].alias("amount"), F.col("category").alias("voucher"))
    return K.result_filter(rows, "review", "view", "12").select("id", "status", "voucher")


@query("flt_03", with_("console", f"SELECT id FROM console WHERE {_REVIEW}"))
def flt_03(spark, sf):
    return console_rows(spark, sf).filter(K.needs_review()).select("id")


@query("flt_04", with_("console", "SELECT DISTINCT category FROM console ORDER BY 1"))
def flt_04(spark, sf):
    return console_rows(spark, sf).select("category").distinct().orderBy("category")


@query("flt_05", with_("books", "SELECT coalesce(currency, 'INR') = 'INR' AS in_base, count(*) AS n_rows FROM books GROUP BY 1"))
def flt_05(spark, sf):
    return T.books(spark, sf).groupBy((F.coalesce("currency", F.lit("INR")) == "INR").alias("in_base")).agg(F.count(F.lit(1)).alias("n_rows"))


# predictions: actual label, two models, a score and a split group
def predictions(spark, sf):
    k = F.col("ord")
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord")).select(
        k, T.category_at(k).alias("actual"), T.category_at(k + F.when(k % 9 == 0, 1).otherwise(0)).alias("pred_a"),
        T.category_at(k + F.when(k % 4 == 0, 3).otherwise(0)).alias("pred_b"), ((k % 100).cast("double") / 100).alias("score"),
        (k % 25).alias("split_group"))


cte("predictions", (), f"""
SELECT ord, {category_sql('ord')} AS actual, {category_sql('ord + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END')} AS pred_a,
 {category_sql('ord + CASE WHEN ord % 4 = 0 THEN 3 ELSE 0 END')} AS pred_b, CAST(ord % 100 AS DOUBLE) / 100 AS score, ord % 25 AS split_group
FROM (SELECT o_orderkey AS ord FROM orders)""")


def keep_known(rows, train, label="actual"):
    """Rows whose label was seen in training; the labels are few, so the right side is a distinct list."""
    return rows.join(train.select(F.col(label)).distinct(), label, "left_semi")


@query("flt_06", with_("predictions", """
SELECT kept, count(*) AS n_rows FROM (SELECT actual IN (SELECT DISTINCT actual FROM predictions WHERE split_group < 5 AND actual <> 'Journal') AS kept
FROM predictions WHERE split_group >= 20) GROUP BY 1"""))
def flt_06(spark, sf):
    p = predictions(spark, sf)
    known = p.filter("split_group < 5 AND actual <> 'Journal'").select("actual").distinct().withColumn("seen", F.lit(True))
    return p.filter("split_group >= 20").join(known, "actual", "left").groupBy(
        F.coalesce("seen", F.lit(False)).alias("kept")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("flt_07", with_("predictions", f"SELECT ord, actual FROM predictions WHERE ord NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND actual IN ({lits(schema.TAXONOMY)})"))
def flt_07(spark, sf):
    disputed = T.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord"))
    taxonomy = fixed_table(spark, "actual", [(t,) for t in schema.TAXONOMY])
    return predictions(spark, sf).join(disputed, "ord", "left_anti").join(F.broadcast(taxonomy), "actual", "left_semi").select("ord", "actual")


@query("flt_08", with_("predictions", "SELECT ord, actual, pred_a FROM predictions WHERE actual <> pred_a"))
def flt_08(spark, sf):
    return predictions(spark, sf).filter("actual <> pred_a").select("ord", "actual", "pred_a")


@query("flt_09", "SELECT doc_id FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL AND source <> ''")
def flt_09(spark, sf):
    return T.table(spark, sf, "documents").filter((F.trim("text") != "") & F.col("lang").isNotNull() & (F.col("source") != "")).select("doc_id")


@query("flt_10", with_("serialised", "SELECT trim(serialised) = '' AS empty_input, count(*) AS n_rows FROM serialised GROUP BY 1"))
def flt_10(spark, sf):
    df = wide_vouchers(spark, sf)
    return df.select((F.trim(normalization.serialise(df)) == "").alias("empty_input")).groupBy("empty_input").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- aggregates
@query("agg_01", with_("books", "SELECT category, count(*) AS n_rows, count(taxable_value) AS have, CAST(CAST(sum(taxable_value) AS DECIMAL(28,2)) AS VARCHAR) AS total FROM books GROUP BY 1"))
def agg_01(spark, sf):
    return T.books(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count("taxable_value").alias("have"),
                                                      F.sum("taxable_value").cast("decimal(28,2)").cast("string").alias("total"))


@query("agg_02", with_("console", "SELECT category, count(*) AS n_rows FROM console GROUP BY 1"))
def agg_02(spark, sf):
    return console_rows(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "category")


@query("agg_03", with_("predictions", "SELECT actual, count(*) AS reviewed, count_if(pred_a = actual) AS a_agrees, count_if(pred_b = actual) AS b_agrees FROM predictions GROUP BY 1"))
def agg_03(spark, sf):
    return predictions(spark, sf).groupBy("actual").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("pred_a") == F.col("actual")).alias("a_agrees"),
                                                        F.count_if(F.col("pred_b") == F.col("actual")).alias("b_agrees"))


@query("agg_04", with_("predictions", "SELECT actual, count(DISTINCT pred_b) AS predicted_labels, count(DISTINCT split_group) AS split_groups FROM predictions GROUP BY 1"))
def agg_04(spark, sf):
    return predictions(spark, sf).groupBy("actual").agg(F.countDistinct("pred_b").alias("predicted_labels"), F.countDistinct("split_group").alias("split_groups"))


_MISSING = ("currency", "taxable_value", "gst_rate", "cgst", "sgst", "igst", "cess", "total_tax", "total_amount", "invoice_number", "invoice_date", "party_gstin")


def missing_rates(df, columns):
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 3).alias(c) for c in columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing_rate")) for c in columns])).alias("e")).select("e.*")


@query("agg_05", with_("books", " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS missing_rate FROM books" for c in _MISSING)))
def agg_05(spark, sf):
    return missing_rates(T.books(spark, sf), _MISSING)


@query("agg_06", with_("books", "SELECT category, currency, ledger, ambiguous, count(*) AS n_rows FROM books GROUP BY ALL"))
def agg_06(spark, sf):
    return T.books(spark, sf).groupBy("category", "currency", "ledger", "ambiguous").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"))


@query("agg_07", with_("console", "SELECT status, count(*) AS n_rows, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM console), 1) AS percent FROM console GROUP BY 1"))
def agg_07(spark, sf):
    return K.share_by_status(console_rows(spark, sf), "status")


@query("agg_08", with_("console", """
SELECT category, round(avg(score), 9) AS mean_score, round(stddev_samp(score), 9) AS sd_score, min(score) AS lo, max(score) AS hi FROM console GROUP BY 1"""))
def agg_08(spark, sf):
    return console_rows(spark, sf).groupBy("category").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.stddev_samp("score"), 9).alias("sd_score"),
                                                           F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("agg_09", with_("books", """
SELECT category, array_to_string(list_slice(list(source_ref ORDER BY ord), 1, 50), ',') AS refs FROM books GROUP BY 1"""))
def agg_09(spark, sf):
    from voucherflow.operators.accounting import first_refs
    return first_refs(T.books(spark, sf).select("category", "ord", "source_ref"), ["category"]).select("category", F.array_join("source_refs", ",").alias("refs"))


@query("agg_10", with_("books", "SELECT prefix, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM (SELECT regexp_extract(invoice_number, '^[A-Z-]*[A-Z]') AS prefix, category FROM books WHERE invoice_number IS NOT NULL) GROUP BY 1"))
def agg_10(spark, sf):
    rows = T.books(spark, sf).filter("invoice_number IS NOT NULL").select(F.regexp_extract("invoice_number", "^[A-Z-]*[A-Z]", 0).alias("prefix"), "category")
    return rows.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))


@query("agg_11", with_("predictions", "SELECT split_group, label, n FROM (SELECT split_group, pred_b AS label, count(*) AS n, row_number() OVER (PARTITION BY split_group ORDER BY count(*) DESC, pred_b) AS rn FROM predictions GROUP BY 1, 2) WHERE rn = 1"))
def agg_11(spark, sf):
    """Most frequent label per group, ties to the first name: counts first, then one small minimum."""
    counts = predictions(spark, sf).groupBy("split_group", "pred_b").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("split_group").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("pred_b").alias("label"))).alias("m"))
    return best.select("split_group", "m.label", (-F.col("m.neg")).alias("n"))


_LABELS = sorted(set(T.CATEGORY_BY_SLOT))


@query("agg_12", with_("predictions", "SELECT actual, " + ", ".join(f"count_if(pred_a = '{c}') AS \"{c}\"" for c in _LABELS) + " FROM predictions GROUP BY 1"))
def agg_12(spark, sf):
    return predictions(spark, sf).groupBy("actual").pivot("pred_a", _LABELS).count().na.fill(0)


@query("agg_13", with_("features", "SELECT grp, category, count(*) AS n_rows FROM features WHERE in_base_currency GROUP BY ROLLUP (grp, category)"))
def agg_13(spark, sf):
    return gst.feats(spark, sf).filter("in_base_currency").rollup(F.col("group").alias("grp"), F.col("category").alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- windows, sorts, sets
@query("win_01", with_("console", "SELECT id, count(*) OVER (PARTITION BY file_name, category) AS group_size FROM console"))
def win_01(spark, sf):
    """Group sizes joined back: the counts are few, and no group is gathered."""
    rows = console_rows(spark, sf).select("id", "file_name", "category")
    sizes = rows.groupBy("file_name", "category").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, ["file_name", "category"]).select("id", "group_size")


@query("win_02", with_("console", "SELECT id, row_number() OVER (ORDER BY status, category DESC, id) AS place FROM console"))
def win_02(spark, sf):
    return overall_rank(console_rows(spark, sf).select("id", "status", "category"), [("status", True), ("category", False)], "id", "place").select("id", "place")


@query("win_04", with_("books", "SELECT category, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS rn FROM books) WHERE rn <= 5"))
def win_04(spark, sf):
    w = W.partitionBy("category").orderBy("ord")
    return T.books(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("category", "source_ref")


def repeats(df, keys, order):
    """Rows that repeat an earlier key: everything but the first row of its key."""
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    matched = df.join(first, keys)
    return matched.filter(F.col(order) > F.col("__first")).drop("__first")


@query("win_07", with_("books", "SELECT source_ref, invoice_number FROM (SELECT *, row_number() OVER (PARTITION BY invoice_number ORDER BY ord) AS rn FROM books WHERE invoice_number IS NOT NULL) WHERE rn > 1"))
def win_07(spark, sf):
    rows = T.books(spark, sf).filter("invoice_number IS NOT NULL").select("ord", "source_ref", "invoice_number")
    return repeats(rows, ["invoice_number"], "ord").select("source_ref", "invoice_number")


@query("win_08", "SELECT count(*) AS duplicated_rows FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn > 1")
def win_08(spark, sf):
    return duplicated(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicated(df, keys):
    """Rows beyond the first of each key, as a count over counts."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicated_rows"))


_SLICES = """
SELECT label, sum(n) AS value FROM (SELECT CASE WHEN rn <= 5 THEN {0} ELSE 'Other' END AS label, n FROM (SELECT {0}, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, {0}) AS rn FROM {1} GROUP BY 1)) GROUP BY 1"""


@query("top_02", with_("books", _SLICES.format("category", "books").replace("sum(n)", "CAST(sum(n) AS BIGINT)")))
def top_02(spark, sf):
    counts = T.books(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return K.fold_slices(counts)


@query("top_03", with_("predictions", "SELECT actual, pred_b AS predicted, count(*) AS n FROM predictions WHERE actual <> pred_b GROUP BY 1, 2 ORDER BY n DESC, actual, predicted LIMIT 10"))
def top_03(spark, sf):
    return predictions(spark, sf).filter("actual <> pred_b").groupBy("actual", F.col("pred_b").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "actual", "predicted").limit(10)


@query("top_05", with_("console", "SELECT id FROM (SELECT * FROM console ORDER BY created_at DESC, id LIMIT 5000) ORDER BY created_at DESC, id LIMIT 100 OFFSET 100"))
def top_05(spark, sf):
    """The second page of what the store keeps, by the key that the first one ends with."""
    kept = K.retained(console_rows(spark, sf).select("created_at", "id"))
    return K.page_after(kept, K.PAGE, K.last_key(K.page_after(kept, K.PAGE))).select("id")


@query("top_06", with_("raw books", """
SELECT r.source_ref, b.category, CASE WHEN r."GSTIN" IS NOT NULL THEN '[redacted]' END AS "GSTIN", r."Invoice Value" FROM raw r JOIN books b USING (source_ref)
WHERE b.ambiguous ORDER BY b.ord LIMIT 20"""))
def top_06(spark, sf):
    from voucherflow.operators.normalize import redact
    weak = T.books(spark, sf).filter("ambiguous").select("source_ref", "category")
    rows = normalization.books_raw(spark, sf).join(weak, "source_ref")
    return redact(rows, keep=("ord", "source_ref", "category")).orderBy("ord").limit(20).select("source_ref", "category", "GSTIN", "Invoice Value")


@query("top_07", with_("predictions", """
SELECT model, accuracy FROM (SELECT 'b' AS model, 1 AS simplicity, round(avg(CASE WHEN pred_b = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy FROM predictions
UNION ALL SELECT 'a', 2, round(avg(CASE WHEN pred_a = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) FROM predictions) ORDER BY accuracy DESC, simplicity, model LIMIT 1"""))
def top_07(spark, sf):
    scores = predictions(spark, sf).agg(*[F.round(F.avg((F.col(f"pred_{m}") == F.col("actual")).cast("double")), 4).alias(m) for m in "ab"])
    tall = scores.select(F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(2).alias("simplicity"), F.col("a").alias("accuracy")),
                                           F.struct(F.lit("b").alias("model"), F.lit(1).alias("simplicity"), F.col("b").alias("accuracy")))).alias("e")).select("e.*")
    return tall.orderBy(F.desc("accuracy"), "simplicity", "model").limit(1).select("model", "accuracy")


@query("set_01", with_("predictions", "SELECT ord, pred_a AS label, 'consensus' AS part FROM predictions WHERE pred_a = pred_b UNION ALL SELECT ord, 'NEEDS_ADJUDICATION', 'disputed' FROM predictions WHERE pred_a <> pred_b"))
def set_01(spark, sf):
    p = predictions(spark, sf)
    return p.filter("pred_a = pred_b").select("ord", F.col("pred_a").alias("label"), F.lit("consensus").alias("part")).unionByName(
        p.filter("pred_a <> pred_b").select("ord", F.lit("NEEDS_ADJUDICATION").alias("label"), F.lit("disputed").alias("part")))


@query("set_02", f"SELECT unnest({sql_list(schema.TAXONOMY)}) AS label EXCEPT SELECT {category_sql('o_orderkey')} FROM orders")
def set_02(spark, sf):
    return fixed_table(spark, "label", [(t,) for t in schema.TAXONOMY]).exceptAll(predictions(spark, sf).select(F.col("actual").alias("label")).distinct())


@query("set_03", "SELECT o_custkey AS party FROM orders WHERE o_orderkey % 5 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1")
def set_03(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("party"))
    return o.filter("o_orderkey % 5 = 0").select("party").intersect(o.filter("o_orderkey % 5 = 1").select("party"))


@query("set_04", with_("predictions", """
SELECT ord, CASE WHEN pred_a = pred_b THEN CASE WHEN actual = pred_a THEN actual ELSE actual || '|' || pred_a END
 WHEN actual = pred_a THEN actual || '|' || pred_b WHEN actual = pred_b THEN actual || '|' || pred_a ELSE actual || '|' || pred_a || '|' || pred_b END AS candidates FROM predictions"""))
def set_04(spark, sf):
    return predictions(spark, sf).select("ord", F.array_join(F.array_distinct(F.concat(F.array("actual"), F.array("pred_a", "pred_b"))), "|").alias("candidates"))


@query("set_05", with_("predictions", "SELECT count_if(pred_a <> pred_b) AS cells_differ, count(*) AS n_rows FROM predictions"))
def set_05(spark, sf):
    p = predictions(spark, sf)
    left, right = p.select("ord", F.col("pred_a").alias("l")), p.select("ord", F.col("pred_b").alias("r"))
    return left.join(right, "ord", "full").agg(F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("cells_differ"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- console figures
@query("dsh_01", with_("console all_disc per_row verdict_in", f"""
SELECT count(*) AS total, count_if(CAST(created_at AS DATE) = DATE '2024-01-15') AS today, count_if({_REVIEW}) AS pending_review,
 round(avg(score), 9) AS mean_score, count(DISTINCT file_name) AS files,
 (SELECT count_if(severity IN ('HIGH', 'MEDIUM')) FROM all_disc) AS finding_groups, (SELECT count(*) FROM per_row WHERE worst < 3) AS rows_with_findings,
 (SELECT {gst.READINESS_SQL} FROM verdict_in) AS readiness FROM console"""))
def dsh_01(spark, sf):
    """The console's row of eight figures: its own in one pass, and those of the analysed books."""
    f, groups, calcs = gst.analysed(spark, sf)
    blocking, touched = K.finding_figures(groups, gst.V.row_findings(gst.V.findings(f, gst.RULES), gst.RULES))
    ready = gst.FI.verdict(f, groups, calcs).select("readiness")
    out = K.key_figures(console_rows(spark, sf), "2024-01-15").withColumn("mean_score", F.round("mean_score", 9))
    return out.join(F.broadcast(blocking)).join(F.broadcast(touched)).join(F.broadcast(ready))      # one row each


@query("dsh_02", with_("console", """
SELECT CAST(day AS VARCHAR) AS day, count(id) AS n_rows FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-26', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN console ON CAST(created_at AS DATE) = day GROUP BY 1"""))
def dsh_02(spark, sf):
    return K.per_day(console_rows(spark, sf), "2024-02-01").withColumn("day", F.col("day").cast("string"))


@query("dsh_03", with_("console", _SLICES.format("category", "console").replace("rn <= 5", "rn <= 3").replace("sum(n)", "CAST(sum(n) AS BIGINT)")))
def dsh_03(spark, sf):
    return K.fold_slices(console_rows(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")), 3)


@query("dsh_04", with_("console", "SELECT file_name, count(*) AS n_rows, CAST(max(created_at) AS VARCHAR) AS last_at FROM console GROUP BY 1 ORDER BY max(created_at) DESC LIMIT 50"))
def dsh_04(spark, sf):
    return K.upload_log(console_rows(spark, sf)).withColumn("last_at", F.col("last_at").cast("string"))


@query("dsh_05", with_("console", f"SELECT file_name, count(*) AS n_rows, count(DISTINCT category) AS categories, count_if({_REVIEW}) AS to_review FROM console GROUP BY 1"))
def dsh_05(spark, sf):
    return K.batch_card(console_rows(spark, sf))


@query("dsh_06", with_("wide", "SELECT column_name FROM (" + " UNION ALL ".join(
    f'SELECT {i} AS pos, \'{c}\' AS column_name, min(ord) AS ord FROM wide WHERE "{c}" IS NOT NULL' for i, c in enumerate(WIDE_COLUMNS))
    + ") WHERE ord IS NOT NULL ORDER BY ord, pos LIMIT 5"))
def dsh_06(spark, sf):
    from voucherflow.operators.normalize import raw_map
    df = wide_vouchers(spark, sf).drop("Voucher Category")
    return K.observed_columns(df.select(F.col("ord").alias("id"), raw_map(df).alias("record"))).select("column_name")


# ---------------------------------------------------------------- certificates
def vouchers(spark, sf):
    b = T.books(spark, sf).filter("invoice_number IS NOT NULL")
    return b.select("ord", F.col("invoice_number").alias("certificate_number"), F.coalesce("invoice_date", F.lit("2000-01-01").cast("date")).alias("issued_at"),
                    CE.voucher_hash("source_ref", "taxable_value", "total_tax").alias("voucher_hash"))


cte("vouchers", ("books",), """
SELECT ord, invoice_number AS certificate_number, coalesce(invoice_date, DATE '2000-01-01') AS issued_at,
 sha256(source_ref || '|' || coalesce(CAST(taxable_value AS VARCHAR), '') || '|' || coalesce(CAST(total_tax AS VARCHAR), '')) AS voucher_hash
FROM books WHERE invoice_number IS NOT NULL""")
cte("certified", ("vouchers",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY certificate_number ORDER BY issued_at, ord) AS rn FROM vouchers) WHERE rn = 1")


@query("crt_01", with_("certified", "SELECT certificate_number, voucher_hash, CAST(issued_at AS VARCHAR) AS issued_at FROM certified WHERE certificate_number NOT IN (SELECT certificate_number FROM vouchers WHERE ord % 10 = 0)"))
def crt_01(spark, sf):
    new = vouchers(spark, sf)
    return CE.certify(new, CE.certify(new.filter("ord % 10 = 0"))).withColumn("issued_at", F.col("issued_at").cast("string"))


@query("crt_02", with_("certified", """
SELECT q.certificate_number, c.voucher_hash, c.certificate_number IS NOT NULL AS found FROM (SELECT 'INV-' || CAST(o_orderkey * 2 AS VARCHAR) AS certificate_number FROM orders) q
LEFT JOIN certified c USING (certificate_number)"""))
def crt_02(spark, sf):
    asked = T.table(spark, sf, "orders").select(F.concat(F.lit("INV-"), (F.col("o_orderkey") * 2).cast("string")).alias("certificate_number"))
    return CE.lookup(asked, CE.certify(vouchers(spark, sf))).select("certificate_number", "voucher_hash", "found")


@query("crt_03", with_("certified", "SELECT v.certificate_number, v.ord, v.voucher_hash = c.voucher_hash AS matches FROM vouchers v LEFT JOIN certified c USING (certificate_number)"))
def crt_03(spark, sf):
    rows = vouchers(spark, sf)
    return CE.verify(rows, CE.certify(rows)).select("certificate_number", "ord", "matches")


# ---------------------------------------------------------------- file checks and joins
@query("val_37", with_("books", """
SELECT count_if(length(coalesce(party_gstin, '')) < 15) AS short_gstins, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM
 (SELECT coalesce(invoice_number, 'INV-' || CAST(ord + 1000 AS VARCHAR)) AS inv FROM books) GROUP BY inv)) AS repeated_numbers, true AS enough_columns FROM books"""))
def val_37(spark, sf):
    b = T.books(spark, sf)
    numbers = b.select(F.coalesce("invoice_number", F.concat(F.lit("INV-"), (F.col("ord") + 1000).cast("string"))).alias("inv"))
    from voucherflow.operators.filing import merge_single_rows
    short = b.agg(F.count_if(F.length(F.coalesce("party_gstin", F.lit(""))) < 15).alias("short_gstins"))
    again = duplicated(numbers, ["inv"]).withColumnRenamed("duplicated_rows", "repeated_numbers")
    return merge_single_rows(short, again).withColumn("enough_columns", F.lit(len(b.columns) >= 3))


@query("jon_05", with_("predictions", "SELECT ord FROM predictions WHERE split_group IN (SELECT split_group FROM predictions WHERE score > 0.97)"))
def jon_05(spark, sf):
    p = predictions(spark, sf)
    return p.join(p.filter("score > 0.97").select("split_group").distinct(), "split_group", "left_semi").select("ord")


@query("jon_06", with_("predictions", "SELECT ord FROM predictions WHERE split_group NOT IN (SELECT split_group FROM predictions WHERE score > 0.97)"))
def jon_06(spark, sf):
    p = predictions(spark, sf)
    return p.join(p.filter("score > 0.97").select("split_group").distinct(), "split_group", "left_anti").select("ord")


@query("jon_08", with_("predictions", f"SELECT t.label, count(p.ord) AS n_rows FROM (SELECT unnest({sql_list(schema.TAXONOMY)}) AS label) t LEFT JOIN predictions p ON p.actual = t.label GROUP BY 1"))
def jon_08(spark, sf):
    counts = predictions(spark, sf).groupBy(F.col("actual").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return fixed_table(spark, "label", [(t,) for t in schema.TAXONOMY]).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("jon_09", with_("predictions", "SELECT count(*) AS shared FROM (SELECT split_group FROM predictions WHERE ord % 2 = 0 INTERSECT SELECT split_group FROM predictions WHERE ord % 3 = 1)"))
def jon_09(spark, sf):
    p = predictions(spark, sf)
    return p.filter("ord % 2 = 0").select("split_group").distinct().join(p.filter("ord % 3 = 1").select("split_group").distinct(), "split_group").agg(F.count(F.lit(1)).alias("shared"))


def compare_values(reported, recomputed, key, tolerance=1e-9):
    """Full outer comparison of two (key, value) tables."""
    both = reported.select(key, F.col("value").alias("reported")).join(recomputed.select(key, F.col("value").alias("recomputed")), key, "full")
    close = F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) < tolerance, F.lit(False))
    return both.withColumn("status", F.when(close, "PASS").otherwise("FAIL"))


@query("jon_10", with_("predictions", """
SELECT label, CASE WHEN abs(r - c) < 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT coalesce(a.label, b.label) AS label, a.r, b.c FROM
 (SELECT actual AS label, CAST(count(*) AS DOUBLE) AS r FROM predictions GROUP BY 1) a FULL JOIN (SELECT pred_b AS label, CAST(count(*) AS DOUBLE) AS c FROM predictions GROUP BY 1) b ON a.label = b.label)"""))
def jon_10(spark, sf):
    p = predictions(spark, sf)
    count = lambda c: p.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return compare_values(count("actual"), count("pred_b"), "label").select("label", "status")


def sanitise_commentary(notes, codes, shown=30, max_text=1200):
    """Outside commentary kept only where it names a known code; text trimmed, list capped by arrival order."""
    known = notes.join(codes.select("code").distinct(), "code", "left_semi")
    kept = known.orderBy("note_id").limit(shown)
    return kept.select("note_id", "code", F.substring(F.trim("note"), 1, max_text).alias("note"))


@query("jon_11", with_("found", """
SELECT note_id, code, note FROM (SELECT doc_id AS note_id, CASE doc_id % 4 WHEN 0 THEN 'TAX_AMOUNT_MISMATCH' WHEN 1 THEN 'NO_SUCH_CODE' WHEN 2 THEN 'CGST_SGST_UNEQUAL' ELSE 'MADE_UP' END AS code,
 substr(trim(text), 1, 1200) AS note FROM documents) WHERE code IN (SELECT code FROM found) ORDER BY note_id LIMIT 30"""))
def jon_11(spark, sf):
    from voucherflow.operators import validation as V
    d = T.table(spark, sf, "documents")
    notes = d.select(F.col("doc_id").alias("note_id"), T.pick(F.col("doc_id") % 4, ("TAX_AMOUNT_MISMATCH", "NO_SUCH_CODE", "CGST_SGST_UNEQUAL", "MADE_UP")).alias("code"), F.col("text").alias("note"))
    codes = V.discrepancy_counts(V.findings(gst.feats(spark, sf)))
    return sanitise_commentary(notes, codes)

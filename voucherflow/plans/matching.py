"""Queries for portal matching, agreement, intervals and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from voucherflow.operators import matching as MA
from voucherflow.operators import metrics as M
from voucherflow.plans import classification as CL
from voucherflow.plans import console as CN
from voucherflow.plans import evaluation as EV
from voucherflow.plans import gst
from voucherflow.plans.ctes import cte, money, with_
from voucherflow.plans.registry import query


def _inward(spark, sf):
    f = gst.feats(spark, sf).filter("group = 'inward' AND tax IS NOT NULL")
    return f.select("ord", F.coalesce("supplier_gstin", F.lit("")).alias("gstin"), F.coalesce("invoice_number", F.lit("")).alias("number"),
                    F.col("invoice_date").alias("doc_date"), F.col("tax").cast("decimal(28,2)").alias("value"))


def _portal(rows):
    kept = rows.filter("ord % 8 <> 0").withColumn("value", F.when(F.col("ord") % 9 == 0, F.col("value") + 10).otherwise(F.col("value")).cast("decimal(28,2)"))
    extra = rows.filter("ord % 50 = 7").withColumn("number", F.concat("number", F.lit("-X")))
    return kept.unionByName(extra)


cte("inward", ("features",), "SELECT ord, coalesce(supplier_gstin, '') AS gstin, coalesce(invoice_number, '') AS number, invoice_date AS doc_date, CAST(tax AS DECIMAL(28,2)) AS value FROM features WHERE grp = 'inward' AND tax IS NOT NULL")
cte("portal", ("inward",), "SELECT ord, gstin, number, doc_date, CAST(CASE WHEN ord % 9 = 0 THEN value + 10 ELSE value END AS DECIMAL(28,2)) AS value FROM inward WHERE ord % 8 <> 0 UNION ALL SELECT ord, gstin, number || '-X', doc_date, value FROM inward WHERE ord % 50 = 7")
cte("matched", ("inward", "portal"), """
SELECT gstin, number, doc_date, b.v AS book_value, p.v AS portal_value, CASE WHEN p.n IS NULL THEN 'MISSING_IN_PORTAL' WHEN b.n IS NULL THEN 'MISSING_IN_BOOKS' WHEN abs(b.v - p.v) <= 1 THEN 'MATCHED' ELSE 'VALUE_MISMATCH' END AS match_status
FROM (SELECT gstin, number, doc_date, sum(value) AS v, count(*) AS n FROM inward WHERE gstin <> '' AND number <> '' AND doc_date IS NOT NULL GROUP BY 1, 2, 3) b
FULL JOIN (SELECT gstin, number, doc_date, sum(value) AS v, count(*) AS n FROM portal WHERE gstin <> '' AND number <> '' AND doc_date IS NOT NULL GROUP BY 1, 2, 3) p USING (gstin, number, doc_date)
UNION ALL SELECT gstin, number, doc_date, sum(value), NULL, 'NO_IDENTITY' FROM inward WHERE gstin = '' OR number = '' OR doc_date IS NULL GROUP BY 1, 2, 3
UNION ALL SELECT gstin, number, doc_date, NULL, sum(value), 'NO_IDENTITY' FROM portal WHERE gstin = '' OR number = '' OR doc_date IS NULL GROUP BY 1, 2, 3""")


@query("spc_01", with_("matched", f"SELECT gstin, number, CAST(doc_date AS VARCHAR) AS doc_date, {money('book_value')} AS book_value, {money('portal_value')} AS portal_value, match_status FROM matched"))
def spc_01(spark, sf):
    rows = _inward(spark, sf)
    two = lambda n: F.col(n).cast("decimal(28,2)").cast("string").alias(n)
    return MA.match_portal(rows, _portal(rows)).select("gstin", "number", F.col("doc_date").cast("string").alias("doc_date"), two("book_value"), two("portal_value"), "match_status")


_PV = "(SELECT CAST(sum(portal_value) AS DECIMAL(28,2)) FROM matched)"


@query("spc_02", with_("calcs matched", f"""
SELECT line, value, status, CASE WHEN name = 'itc_tax_with_basic_evidence' THEN CAST({_PV} AS VARCHAR) END AS portal_value,
 CASE WHEN name = 'itc_tax_with_basic_evidence' THEN CAST(CAST(CAST(value AS DECIMAL(28,2)) - {_PV} AS DECIMAL(28,2)) AS VARCHAR) END AS variance
FROM (VALUES ('3.1(a) outward taxable value', 'outward_taxable_value'), ('3.1(a) outward tax', 'outward_total_tax'), ('3.1(c) zero tax value', 'zero_tax_value'),
 ('4(A) credit with evidence', 'itc_tax_with_basic_evidence'), ('4(B) credit reversed by debit notes', 'debit_notes_total_tax'), ('4(C) net credit', 'potential_itc_after_debit_notes')) AS l(line, name)
JOIN calcs USING (name)"""))
def spc_02(spark, sf):
    rows = _inward(spark, sf)
    return MA.return_tables(gst._calcs(spark, sf), MA.match_portal(rows, _portal(rows)))


@query("spc_03", with_("books", """
SELECT dup_hash, count(*) AS n_rows, min(period) AS first_period, max(period) AS last_period FROM (SELECT md5(coalesce(party_gstin, '') || '|' || CASE WHEN ord % 4 = 0 THEN 'INV-R' ELSE coalesce(invoice_number, '') END || '|'
 || CASE WHEN ord % 4 = 0 THEN '' ELSE coalesce(CAST(taxable_value AS VARCHAR), '') END) AS dup_hash, coalesce(strftime(invoice_date, '%Y-%m'), '') AS period FROM books) GROUP BY 1 HAVING min(period) <> max(period)"""))
def spc_03(spark, sf):
    from voucherflow.sources import tables as T
    b = T.books(spark, sf)
    again = F.col("ord") % 4 == 0
    rows = b.select(MA.composite_hash(F.col("party_gstin"), F.when(again, "INV-R").otherwise(F.col("invoice_number")), F.when(~again, F.col("taxable_value"))).alias("dup_hash"),
                    F.coalesce(F.date_format("invoice_date", "yyyy-MM"), F.lit("")).alias("period"))
    return MA.repeated_across_periods(rows)


@query("spc_04", with_("predictions", "SELECT ord, CASE WHEN pred_a = pred_b THEN 'pseudo_label' ELSE 'hard_negative' END AS queue, CASE WHEN pred_a = pred_b THEN pred_a END AS pseudo_label FROM predictions"))
def spc_04(spark, sf):
    return MA.agreement_split(CN.predictions(spark, sf), "pred_a", "pred_b").select("ord", "queue", "pseudo_label")


@query("spc_05", with_("predictions", """
SELECT n, agree, round(po, 9) AS observed, round(pe, 9) AS chance, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT n, agree, agree / n::DOUBLE AS po, (SELECT sum(a.c::DOUBLE / n * (b.c::DOUBLE / n)) FROM
 (SELECT pred_a AS l, count(*) AS c FROM predictions GROUP BY 1) a JOIN (SELECT pred_b AS l, count(*) AS c FROM predictions GROUP BY 1) b USING (l)) AS pe FROM (SELECT count(*) AS n, count_if(pred_a = pred_b) AS agree FROM predictions))"""))
def spc_05(spark, sf):
    pairs = CN.predictions(spark, sf).groupBy(F.col("pred_a").alias("actual"), F.col("pred_b").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return EV._rounded(M.agreement(pairs), "observed", "chance", "kappa")


@query("spc_05_class", with_("predictions", """
SELECT label, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, round(po, 9) AS observed, round(pe, 9) AS chance, round((po - pe) / (1 - pe), 9) AS kappa FROM (
 SELECT label, n, tp, 1.0::DOUBLE - (a + b - 2 * tp)::DOUBLE / n AS po, a::DOUBLE / n * (b::DOUBLE / n) + (1.0::DOUBLE - a::DOUBLE / n) * (1.0::DOUBLE - b::DOUBLE / n) AS pe FROM (
  SELECT label, (SELECT count(*) FROM predictions) AS n, count_if(pred_a = label) AS a, count_if(pred_b = label) AS b, count_if(pred_a = label AND pred_b = label) AS tp
  FROM predictions, (SELECT DISTINCT label FROM (SELECT pred_a AS label FROM predictions UNION ALL SELECT pred_b FROM predictions)) GROUP BY label))"""))
def spc_05_class(spark, sf):
    pairs = CN.predictions(spark, sf).groupBy(F.col("pred_a").alias("actual"), F.col("pred_b").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return EV._rounded(M.class_agreement(pairs), "observed", "chance", "kappa")


@query("spc_06", with_("classes", """
SELECT model, label, support, round((p + zz / (2 * support) - 1.96::DOUBLE * sqrt(p * (1 - p) / support + zz / (4.0::DOUBLE * support * support))) / (1 + zz / support), 9) AS lo,
 round((p + zz / (2 * support) + 1.96::DOUBLE * sqrt(p * (1 - p) / support + zz / (4.0::DOUBLE * support * support))) / (1 + zz / support), 9) AS hi
FROM (SELECT model, label, support, recall AS p, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM classes WHERE support > 0)"""))
def spc_06(spark, sf):
    rows = M.per_class(M.pair_counts(EV.long_predictions(spark, sf))).filter("support > 0")
    lo, hi = M.wilson(F.col("recall") * F.col("support"), F.col("support").cast("double"))
    return rows.select("model", "label", "support", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


_DRAWN = " + ".join(f"CASE WHEN u >= {edge!r}::DOUBLE THEN 1 ELSE 0 END" for edge in MA.poisson_edges())


@query("spc_bootstrap", with_("predictions", f"""
SELECT round, round(sum(w * hits) / sum(w * n)::DOUBLE, 9) AS accuracy FROM (SELECT *, ({_DRAWN}) AS w
FROM (SELECT split_group, n, hits, round, CAST('0x' || substr(md5(CAST(split_group AS VARCHAR) || '/' || CAST(round AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
FROM (SELECT split_group, count(*) AS n, count_if(pred_a = actual) AS hits FROM predictions GROUP BY 1), (SELECT unnest(range(1, 51)) AS round))) GROUP BY 1"""))
def spc_bootstrap(spark, sf):
    return MA.bootstrap_clusters(CN.predictions(spark, sf), "split_group", F.col("pred_a") == F.col("actual"), 50).select(
        F.col("round").cast("bigint").alias("round"), F.round("accuracy", 9).alias("accuracy"))


@query("spc_07", with_("clause_hits decided", """
SELECT basis, count(*) AS n_rows, count_if(category = label) AS correct, count_if(flagged) AS flagged, count_if(flagged AND category <> label) AS flagged_wrong
FROM (SELECT DISTINCT h.source_ref, h.basis, h.category, d.label, d.rule_status IN ('REVIEW_REQUIRED', 'AMBIGUOUS') AS flagged FROM clause_hits h JOIN decided d USING (source_ref)) GROUP BY 1"""))
def spc_07(spark, sf):
    """Coverage and precision by evidence basis, and how far review flags point at wrong evidence; one pass over the rows."""
    from voucherflow import schema
    from voucherflow.operators import rules as R
    rows = CL.decided(spark, sf)
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(R.has_any(F.col("clause_bits"), 1 << c.bit), F.struct(
        F.lit(c.basis).alias("basis"), F.lit(c.category).alias("category"))) for c in R.CLAUSES])))
    tall = rows.select(F.col(f"`{schema.LABEL_COLUMN}`").alias("label"), F.col("rule_status").isin(R.REVIEW_REQUIRED, R.AMBIGUOUS).alias("flagged"), F.explode(hits).alias("e"))
    wrong = F.col("e.category") != F.col("label")
    return tall.groupBy("e.basis").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~wrong).alias("correct"), F.count_if("flagged").alias("flagged"),
                                       F.count_if(F.col("flagged") & wrong).alias("flagged_wrong"))


@query("spc_08", with_("long", """
SELECT model, round(sum(n * abs(ms - acc)) / sum(n), 9) AS ece FROM (SELECT model, least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM long GROUP BY 1, 2) GROUP BY 1"""))
def spc_08(spark, sf):
    rows = EV.long_predictions(spark, sf)
    parts = [M.calibration_error(rows.filter(F.col("model") == m)).select(F.lit(m).alias("model"), F.round("ece", 9).alias("ece")) for m in ("a", "b")]
    return parts[0].unionByName(parts[1])

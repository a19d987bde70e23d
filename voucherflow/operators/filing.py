"""Filing-preparation sections, the report verdict and filing readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.functions.literals import fixed_table
from voucherflow.operators.accounting import cents

# Sections and the fields each must have on every row.
REQUIRED = {
    "outward_b2b": ("invoice_number", "invoice_date", "recipient_gstin", "taxable", "tax"),
    "outward_without_valid_recipient_gstin": ("invoice_number", "invoice_date", "taxable", "tax"),
    "exports": ("invoice_number", "invoice_date", "taxable"),
    "inward_with_basic_itc_evidence": ("invoice_number", "invoice_date", "supplier_gstin", "tax"),
    "inward_without_basic_itc_evidence": ("invoice_number", "invoice_date", "supplier_gstin", "tax"),
    "credit_notes": ("invoice_number", "invoice_date", "original_invoice_ref", "tax"),
    "debit_notes": ("invoice_number", "invoice_date", "original_invoice_ref", "tax"),
}
BY_RATE = "outward_without_valid_recipient_gstin"
NO_RATE = "rate not stated"


def section_of() -> Column:
    """Filing section of a base-currency row; null for rows no section takes."""
    c = F.col
    return F.when(c("group") == "outward", F.when(c("category") == "Export", "exports")
                  .when(c("recipient_gstin_status") == "valid", "outward_b2b").otherwise(BY_RATE)) \
        .when(c("group").isin("inward", "expenses"),
              F.when(c("has_itc_evidence"), "inward_with_basic_itc_evidence")
              .otherwise("inward_without_basic_itc_evidence")) \
        .when(c("group").isin("credit_notes", "debit_notes"), c("group"))


def _filled(name: str) -> Column:
    text = name in ("invoice_number", "recipient_gstin", "supplier_gstin", "original_invoice_ref")
    return F.coalesce(F.col(name) != "", F.lit(False)) if text else F.col(name).isNotNull()


def filing_sections(f: DataFrame) -> DataFrame:
    """One row per section; the B2C section has one row per rate as written."""
    c = F.col
    rate_key = F.when(c("section") == BY_RATE, F.coalesce(c("rate_text"), F.lit(NO_RATE))).otherwise("")
    ready = None
    for name, fields in REQUIRED.items():
        test = None
        for field in fields:
            test = _filled(field) if test is None else test & _filled(field)
        ready = F.when(c("section") == name, test) if ready is None else ready.when(c("section") == name, test)
    rows = f.filter("in_base_currency").withColumn("section", section_of()).filter("section IS NOT NULL")
    sums = rows.withColumn("rate_key", rate_key).withColumn("ready", ready).groupBy("section", "rate_key").agg(
        F.count(F.lit(1)).alias("n_rows"), cents(F.sum("taxable")).alias("taxable_value"),
        cents(F.sum("tax")).alias("tax"), F.bool_and("ready").alias("ready"))
    names = fixed_table(f.sparkSession, "section", [(n,) for n in REQUIRED])
    # Seven fixed names on the left, aggregated rows on the right: empty sections stay visible.
    joined = names.join(sums, "section", "left").filter((c("section") != BY_RATE) | c("n_rows").isNotNull())
    return joined.select(
        "section", F.coalesce("rate_key", F.lit("")).alias("rate_key"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        c("taxable_value").cast("string").alias("taxable_value"), c("tax").cast("string").alias("tax"),
        F.when(c("n_rows").isNull(), "NO_DATA").when(c("ready"), "PREPARED_FOR_REVIEW").otherwise("INCOMPLETE")
        .alias("status"))


def merge_single_rows(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(name).alias(name) for name in merged.columns])


def verdict_inputs(f: DataFrame, discrepancies: DataFrame, calcs: DataFrame) -> DataFrame:
    """Usable rows, blocking findings and unsettled figures, in one row."""
    c = F.col
    usable = f.agg(F.count_if(c("in_base_currency") & c("group").isin(*schema.TAX_GROUPS)
                              & (c("taxable").isNotNull() | c("tax").isNotNull())).alias("usable_rows"))
    found = discrepancies.agg(
        F.count_if(c("severity").isin("HIGH", "MEDIUM")).alias("blocking"),
        F.array_sort(F.collect_set(F.when((c("severity") == "HIGH") & (c("status") == "CONFIRMED"), c("code"))))
        .alias("confirmed_high"))
    unsettled = F.when(c("status").isin("INCOMPLETE", "UNRESOLVED"), F.struct("position", "name"))
    open_names = calcs.filter("section = 'gst'").agg(
        F.array_sort(F.collect_list(unsettled))["name"].alias("open_calculations"))   # at most 31 figures
    return merge_single_rows(usable, found, open_names)


def verdict(f: DataFrame, discrepancies: DataFrame, calcs: DataFrame) -> DataFrame:
    """status, route, readiness level and the reasons, in one row."""
    c = F.col
    inputs = verdict_inputs(f, discrepancies, calcs)
    status = F.when(c("usable_rows") == 0, "INSUFFICIENT_DATA") \
        .when((c("blocking") > 0) | (F.size("open_calculations") > 0), "REVIEW_REQUIRED").otherwise("ANALYSIS_COMPLETE")
    reasons = F.when(c("usable_rows") == 0, F.array(F.lit(
        "No outward, inward, note or expense rows with taxable value or tax were found."))) \
        .when(status == "ANALYSIS_COMPLETE", F.array(F.lit("All configured checks passed on the supplied data."))) \
        .otherwise(F.array_compact(F.array(
            F.when(c("blocking") > 0, F.concat(c("blocking").cast("string"),
                                               F.lit(" high/medium discrepancy groups need review."))),
            F.when(F.size("open_calculations") > 0, F.concat(
                F.lit("Incomplete calculations: "), F.array_join(F.slice("open_calculations", 1, 8), ", "))))))
    out = inputs.withColumn("report_status", status).withColumn("reasons", reasons)
    level = F.when((c("report_status") == "INSUFFICIENT_DATA") | (F.size("confirmed_high") > 0), "NOT_READY") \
        .when(c("report_status") == "REVIEW_REQUIRED", "REVIEW_REQUIRED").otherwise("PREPARED_FOR_PROFESSIONAL_REVIEW")
    confirmed = F.when(F.size("confirmed_high") > 0, F.array(F.concat(
        F.lit("Confirmed high-severity issues: "), F.array_join("confirmed_high", ", ")))) \
        .otherwise(F.array().cast("array<string>"))
    return out.withColumn("route", F.when(c("report_status") == "ANALYSIS_COMPLETE", "sufficient").otherwise("review")) \
        .withColumn("readiness", level).withColumn("readiness_reasons", F.concat(c("reasons"), confirmed)) \
        .select("report_status", "route", "readiness", "reasons", "readiness_reasons", "usable_rows", "blocking",
                "confirmed_high", "open_calculations")

"""Discrepancy findings.

Every check is one predicate over the feature row. A row's findings are exploded
as small integer ids and matched to a fixed catalogue of wording, so the wide
text never travels through the shuffle. Groups are counted with partial
aggregates; shown references use a rank that is limited before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voucherflow import schema
from voucherflow.config import Rules
from voucherflow.functions.gstin import gstin_status
from voucherflow.functions.literals import fixed_table
from voucherflow.functions.parsing import flag
from voucherflow.operators.accounting import cents, first_refs
from voucherflow.operators.features import once
from voucherflow.session import ensure_checkpoint_dir

# ---- Fixed values: severity order and the catalogue of findings. ----
SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    status: str
    message: str
    action: str


CATALOGUE: dict[int, Finding] = {i: Finding(*parts) for i, parts in {
    1: ("BUSINESS_GSTIN_INVALID", "HIGH", "CONFIRMED", "The supplied business GSTIN fails validation ({status}).",
        "Correct the business GSTIN supplied with the request."),
    2: ("FOREIGN_CURRENCY_EXCLUDED", "MEDIUM", "CONFIRMED",
        "Rows in a currency other than {base} were excluded from totals.",
        "Provide base-currency values or exchange rates used in the books."),
    3: ("AMBIGUOUS_CLASSIFICATION", "MEDIUM", "POSSIBLE",
        "The voucher classifier's top category is weak or close to the runner-up.",
        "Confirm the voucher type before using the row in GST totals."),
    4: ("TAX_ON_NON_TAX_DOCUMENT", "MEDIUM", "POSSIBLE",
        "Tax amounts appear on rows classified as a non-invoice voucher type (e.g. order, delivery or stock record).",
        "Check whether the classification or the tax fields are wrong; such rows are excluded from GST totals."),
    5: ("INVOICE_NUMBER_MISSING", "HIGH", "CONFIRMED", "Tax documents without an invoice/note number.",
        "Add the invoice or note number from the source document."),
    6: ("INVOICE_DATE_MISSING", "HIGH", "CONFIRMED", "Tax documents without an invoice/note date.",
        "Add the document date; it determines the tax period."),
    7: ("SUPPLIER_GSTIN_MISSING", "HIGH", "CONFIRMED", "Inward documents without a supplier GSTIN.",
        "Obtain the supplier GSTIN from the purchase invoice."),
    8: ("SUPPLIER_GSTIN_INVALID", "HIGH", "CONFIRMED", "Supplier GSTINs that fail format or checksum validation.",
        "Correct the supplier GSTIN against the invoice."),
    9: ("RECIPIENT_GSTIN_MISSING", "MEDIUM", "POSSIBLE",
        "Outward documents without a recipient GSTIN: either unregistered (B2C) supplies or missing data.",
        "Confirm whether each recipient is unregistered; add the GSTIN for registered recipients."),
    10: ("RECIPIENT_GSTIN_INVALID", "HIGH", "CONFIRMED", "Recipient GSTINs that fail format or checksum validation.",
         "Correct the recipient GSTIN."),
    11: ("SUPPLY_VALUE_MISSING", "MEDIUM", "CONFIRMED",
         "Tax documents with neither a taxable value nor a tax amount.",
         "Add taxable value and tax amounts from the source document."),
    12: ("CGST_SGST_UNEQUAL", "HIGH", "CONFIRMED", "CGST and SGST/UTGST differ on the same document.",
         "Check the tax split; intra-state tax is normally split equally."),
    13: ("IGST_WITH_CGST_SGST", "HIGH", "CONFIRMED", "IGST and CGST/SGST are both charged on the same document.",
         "Determine whether the supply is inter-state (IGST) or intra-state (CGST+SGST)."),
    14: ("TAX_COMPONENTS_DO_NOT_SUM", "MEDIUM", "CONFIRMED",
         "Tax components do not add up to the reported total tax.", "Reconcile the tax columns with the invoice."),
    15: ("TAX_TYPE_STATE_MISMATCH", "MEDIUM", "POSSIBLE",
         "GSTIN state codes differ but CGST/SGST was charged (inter-state supplies normally carry IGST).",
         "Check the place of supply; special place-of-supply rules may apply."),
    16: ("TAX_TYPE_STATE_MISMATCH", "MEDIUM", "POSSIBLE",
         "GSTIN state codes match but IGST was charged (intra-state supplies normally carry CGST+SGST).",
         "Check the place of supply; special place-of-supply rules may apply."),
    17: ("UNSUPPORTED_TAX_RATE", "MEDIUM", "CONFIRMED", "Tax rates not in the configured rate list.",
         "Verify the rate; update the configured rate list if it is legitimately missing."),
    18: ("TAX_AMOUNT_MISMATCH", "HIGH", "CONFIRMED",
         "Tax amount differs from taxable value x rate by more than the configured tolerance.",
         "Recompute the tax on the source document; check rate, value and rounding."),
    19: ("TAX_RATE_MISSING", "LOW", "CONFIRMED",
         "Tax rate not stated; the implied rate (tax / taxable value) is shown for review only, not used.",
         "Add the tax rate from the invoice."),
    20: ("IMPLIED_TAX_RATE_UNUSUAL", "MEDIUM", "POSSIBLE",
         "Tax rate not stated and tax / taxable value does not match any configured rate.",
         "Check the tax amount and add the rate from the invoice."),
    21: ("TAXABLE_VALUE_MISSING", "MEDIUM", "CONFIRMED", "Tax is reported without a taxable value.",
         "Add the taxable value so the tax can be verified."),
    22: ("INVOICE_TOTAL_UNRECONCILED", "MEDIUM", "CONFIRMED",
         "Taxable value + tax does not equal the invoice total (round-off, other charges or errors).",
         "Reconcile the invoice total with its components."),
    23: ("NOTE_WITHOUT_ORIGINAL_INVOICE", "HIGH", "CONFIRMED",
         "Credit/debit notes without a reference to the original invoice.",
         "Record the original invoice number and date for each note."),
    24: ("ITC_EVIDENCE_INCOMPLETE", "HIGH", "POSSIBLE",
         "Inward tax that lacks basic ITC evidence (valid supplier GSTIN, invoice number and date); excluded from "
         "potential ITC.", "Collect the missing invoice details before claiming any credit."),
    25: ("DUPLICATE_INVOICE_NUMBER", "HIGH", "CONFIRMED",
         "The same invoice/note number appears more than once for the same series or supplier.",
         "Check whether these rows are duplicates or need distinct numbers."),
    26: ("POSSIBLE_DUPLICATE_DOCUMENT", "MEDIUM", "POSSIBLE",
         "Different invoice numbers with the same party, date and amount.",
         "Confirm these are separate transactions."),
    27: ("ITC_NOT_RECONCILED_EXTERNALLY", "INFO", "CONFIRMED",
         "Input tax credit has not been reconciled with GSTR-2B or GST portal data; none was supplied.",
         "Reconcile purchases with GSTR-2B before relying on any ITC figure."),
    28: ("LEDGER_BALANCE_UNRECONCILED", "MEDIUM", "POSSIBLE",
         "Opening + debits - credits does not equal the reported closing balance for a ledger.",
         "Check the ledger's sign convention and missing entries."),
    29: ("LLM_CLASSIFICATION_CONCERN", "MEDIUM", "POSSIBLE",
         "The narrative model flagged rows whose classifier category may not fit the data.",
         "Review these rows' voucher type; the classifier category was not changed."),
}.items()}

# field and reason recorded when a check finds something missing
NEEDS = {
    "invoice_number": "tax document identity",
    "invoice_date": "tax period and document identity",
    "supplier_gstin": "input tax credit evidence",
    "taxable_value/supply": "supply value",
    "taxable_value/arithmetic": "tax arithmetic verification",
    "gst_rate": "tax arithmetic verification",
    "original_invoice_ref": "credit/debit note linkage",
}
# ---- End of fixed values. ----

IDS = {}
for _id, _finding in CATALOGUE.items():
    IDS.setdefault(_finding.code, []).append(_id)


def catalogue(spark: SparkSession, rules: Rules = Rules()) -> DataFrame:
    """The fixed 29-row wording table."""
    rows = [(i, f.code, f.severity, SEVERITY_RANK[f.severity], f.status,
             f.message.replace("{base}", rules.base_currency), f.action) for i, f in CATALOGUE.items()]
    return fixed_table(spark, "finding_id code severity severity_rank status message action", rows)


def implied_rate() -> Column:
    """tax / taxable as a percentage, two decimals; only read where taxable is positive."""
    c = F.col
    safe = F.when(c("taxable") > 0, c("taxable")).cast("decimal(18,4)")
    return F.round(c("tax").cast("decimal(18,4)") / safe * 100, 2)


def expected_tax() -> Column:
    c = F.col
    return F.round(c("taxable").cast("decimal(20,4)") * c("rate").cast("decimal(9,4)") * F.lit("0.01").cast("decimal(3,2)"), 2)


def check_inputs(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Feature rows plus the terms several checks share, each evaluated once per row."""
    c = F.col
    pos = lambda name: flag(c(name) > 0)
    invoice = c("group").isin(*schema.INVOICE_GROUPS)
    shared = once(f, {
        "k_doc": c("in_base_currency") & c("group").isin(*schema.TAX_GROUPS),
        "k_invoice": c("in_base_currency") & invoice,
        "k_tax": pos("tax"), "k_local": pos("cgst") | pos("sgst"), "k_igst": pos("igst"), "k_parts": c("n_components") > 0,
        "k_states": (c("supplier_gstin_status") == "valid") & (c("recipient_gstin_status") == "valid")
        & (c("n_components") > 0),
        "k_inter": F.substring("supplier_gstin", 1, 2) != F.substring("recipient_gstin", 1, 2),
        "k_expected": expected_tax(),
        "k_implied": F.when(c("rate").isNull() & (c("taxable") > 0) & c("tax").isNotNull(), implied_rate()),
    })
    gap = F.least(*[F.abs(c("k_implied") - F.lit(r)) for r in rules.valid_rates])
    return once(shared, {"k_near": gap <= F.lit(rules.rate_match_tolerance)})


def checks(rules: Rules = Rules()) -> dict[int, Column]:
    """Finding id -> predicate over `check_inputs` rows, for the checks that look at one row only."""
    c = F.col
    tol = F.lit(rules.tax_tolerance)
    base, doc, invoice = c("in_base_currency"), c("k_doc"), c("k_invoice")
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    sup_scope = doc & (c("group").isin("inward", "debit_notes") | ((c("group") == "expenses") & c("k_tax")))
    rec_scope = doc & c("group").isin("outward", "credit_notes") & (c("category") != "Export")
    return {
        2: ~base,
        3: base & c("ambiguous"),
        4: base & (c("group") == "other") & (c("k_tax") | c("k_parts")),
        5: invoice & blank("invoice_number"),
        6: invoice & c("invoice_date").isNull(),
        7: sup_scope & (c("supplier_gstin_status") == "missing"),
        8: sup_scope & ~c("supplier_gstin_status").isin("missing", "valid"),
        9: rec_scope & (c("recipient_gstin_status") == "missing"),
        10: rec_scope & ~c("recipient_gstin_status").isin("missing", "valid"),
        11: invoice & c("taxable").isNull() & c("tax").isNull(),
        12: doc & (F.abs(c("cgst") - c("sgst")) > tol),
        13: doc & c("k_igst") & c("k_local"),
        14: doc & c("k_parts") & (F.abs(c("tax") - c("reported_total_tax")) > tol),
        15: doc & c("k_states") & c("k_inter") & c("k_local"),
        16: doc & c("k_states") & ~c("k_inter") & c("k_igst"),
        17: doc & ~c("rate").isin(*rules.valid_rates),
        18: doc & (F.abs(c("k_expected") - c("tax")) > tol),
        19: doc & c("k_near"),
        20: doc & ~c("k_near"),
        21: doc & c("k_tax") & c("taxable").isNull(),
        22: doc & (F.abs(F.round(c("taxable") + c("tax"), 2) - c("total_amount")) > tol),
        23: doc & c("group").isin("credit_notes", "debit_notes") & blank("original_invoice_ref"),
        24: doc & c("category").isin(*rules.itc_categories) & c("k_tax") & ~c("has_itc_evidence"),
    }


def _evidence() -> Column:
    """Figures behind a finding, as JSON text; null where the row reference says it all."""
    c = F.col
    at = lambda *ids: c("finding_id").isin(*ids)
    text = lambda *names: F.to_json(F.struct(c("source_ref").alias("row"), *[c(n).cast("string").alias(n) for n in names]))
    value = lambda **kw: F.to_json(F.struct(c("source_ref").alias("row"), *[v.cast("string").alias(k) for k, v in kw.items()]))
    return F.when(at(2), text("currency")).when(at(3), text("category", "score")).when(at(4), text("category", "tax")) \
        .when(at(8), value(status=c("supplier_gstin_status"))).when(at(10), value(status=c("recipient_gstin_status"))) \
        .when(at(12), text("cgst", "sgst")).when(at(13), text("igst", "cgst", "sgst")) \
        .when(at(14), value(components_sum=cents(c("tax")), reported_total_tax=c("reported_total_tax"))) \
        .when(at(15, 16), value(supplier_state=F.substring("supplier_gstin", 1, 2),
                                recipient_state=F.substring("recipient_gstin", 1, 2))) \
        .when(at(17), text("rate")) \
        .when(at(18), value(taxable_value=c("taxable"), rate=c("rate"), expected_tax=c("k_expected"),
                            reported_tax=cents(c("tax")))) \
        .when(at(19, 20), value(implied_rate_percent=c("k_implied"))) \
        .when(at(22), value(taxable_plus_tax=cents(c("taxable") + c("tax")), invoice_total=c("total_amount")))


def row_checks(f: DataFrame, rules: Rules = Rules(), with_evidence: bool = False) -> DataFrame:
    """ord, source_ref, finding_id for every row-local finding: no shuffle, safe on a stream."""
    tests = checks(rules)
    ids = F.array(*[F.when(test, F.lit(i)) for i, test in tests.items()])
    f = check_inputs(f, rules)
    if with_evidence:
        out = f.withColumn("finding_id", F.explode(ids)).filter("finding_id IS NOT NULL")
        return out.select("ord", "source_ref", "finding_id", F.lit("").alias("key"), _evidence().alias("evidence"))
    return f.select("ord", "source_ref", F.explode(ids).alias("finding_id")).filter("finding_id IS NOT NULL") \
        .withColumn("key", F.lit(""))


def numbered_rows(f: DataFrame) -> DataFrame:
    """Base-currency tax documents that carry a number, with the keys duplicates are found by."""
    c = F.col
    lower_party = F.lower(F.trim(F.coalesce(c("party_name"), F.lit(""))))
    own = c("group").isin(*schema.OWN_SERIES_GROUPS)
    value = F.coalesce(c("total_amount"), c("taxable"))
    return f.filter(c("in_base_currency") & c("group").isin(*schema.INVOICE_GROUPS) & (c("invoice_number") != "")).select(
        "ord", "source_ref", "group", F.upper(F.trim("invoice_number")).alias("number"),
        F.when(own, "").otherwise(F.coalesce(F.when(c("supplier_gstin") != "", c("supplier_gstin")), lower_party))
        .alias("party"),
        lower_party.alias("party_name"), "invoice_date", cents(value).alias("doc_value"))


def same_number_groups(rows: DataFrame) -> DataFrame:
    """Series or supplier keys whose number occurs more than once (partial counts, then one row per key)."""
    return rows.groupBy("group", "party", "number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def lookalike_groups(rows: DataFrame) -> DataFrame:
    """Party, date and amount shared by more than one distinct number (min and max differ)."""
    return rows.filter("doc_value IS NOT NULL AND invoice_date IS NOT NULL") \
        .groupBy("group", "party_name", "invoice_date", "doc_value") \
        .agg(F.min("number").alias("lo"), F.max("number").alias("hi")).filter("lo <> hi").drop("lo", "hi")


def duplicate_findings(f: DataFrame) -> DataFrame:
    """Rows of both duplicate families.

    Counts are aggregated first and semi-joined back, so no key's rows are ever
    gathered in one task; a hot key on the row side is split by AQE's skew join.
    Both families read the keys twice, so these are written once.
    """
    ensure_checkpoint_dir(f.sparkSession)
    rows = numbered_rows(f).checkpoint()
    same = rows.join(same_number_groups(rows), ["group", "party", "number"], "left_semi").select(
        "ord", "source_ref", F.lit(25).alias("finding_id"), F.concat_ws("|", "group", "number").alias("key"))
    alike = rows.join(lookalike_groups(rows), ["group", "party_name", "invoice_date", "doc_value"], "left_semi").select(
        "ord", "source_ref", F.lit(26).alias("finding_id"),
        F.concat_ws("|", "group", "party_name", F.col("invoice_date").cast("string"), F.col("doc_value").cast("string"))
        .alias("key"))
    return same.unionByName(alike)


def findings(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every row-level finding, uncapped: row-local checks plus duplicates."""
    return row_checks(f, rules).unionByName(duplicate_findings(f))


def books_findings(f: DataFrame, rules: Rules = Rules(), business_gstin: str | None = None,
                   ledgers: DataFrame | None = None) -> DataFrame:
    """Findings about the books as a whole: business GSTIN, unreconciled credit, ledgers."""
    spark = f.sparkSession
    itc = f.agg(F.coalesce(F.bool_or(F.col("category").isin(*rules.itc_categories) & flag(F.col("tax") > 0)),
                           F.lit(False)).alias("hit")).filter("hit").select(
        F.lit(27).alias("finding_id"), F.lit("").alias("key"), F.lit(None).cast("string").alias("detail"))
    out = itc
    if business_gstin:
        status = gstin_status(F.lit(business_gstin.replace(" ", "").upper()), rules.verify_gstin_checksum)
        bad = spark.range(1).select(status.alias("detail")).filter("detail <> 'valid'").select(
            F.lit(1).alias("finding_id"), F.lit("").alias("key"), "detail")
        out = out.unionByName(bad)
    if ledgers is not None:
        out = out.unionByName(ledgers.filter("NOT reconciles").select(
            F.lit(28).alias("finding_id"), F.col("ledger").alias("key"),
            F.concat_ws(" vs ", F.col("closing_reported").cast("string"), F.col("closing_computed").cast("string"))
            .alias("detail")))
    return out


def discrepancy_counts(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (code, key): severity and message of the first row, distinct affected rows."""
    words = F.broadcast(catalogue(found.sparkSession, rules))   # fixed 29 rows
    small = found.groupBy("finding_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    named = small.join(words, "finding_id")
    return named.groupBy("code", "key").agg(
        F.min_by("severity", "first_ord").alias("severity"), F.min_by("severity_rank", "first_ord").alias("severity_rank"),
        F.min_by("status", "first_ord").alias("status"), F.min_by("message", "first_ord").alias("message"),
        F.min_by("action", "first_ord").alias("recommended_action"), F.sum("n").alias("affected_rows"),
        F.min("first_ord").alias("first_ord"))


def discrepancies(found: DataFrame, whole: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """All discrepancy groups, row-level and books-level, ready to sort by severity_rank, code, first_ord."""
    counts = discrepancy_counts(found, rules)
    if whole is None:
        return counts
    words = F.broadcast(catalogue(found.sparkSession, rules))
    extra = whole.join(words, "finding_id").select(
        "code", "key", "severity", "severity_rank", "status",
        F.regexp_replace("message", r"\{status\}", F.coalesce("detail", F.lit(""))).alias("message"),
        F.col("action").alias("recommended_action"), F.lit(0).cast("bigint").alias("affected_rows"),
        F.lit(None).cast("bigint").alias("first_ord"))
    return counts.unionByName(extra)


def discrepancy_refs(found: DataFrame, shown: int = schema.REFS_SHOWN, rules: Rules = Rules()) -> DataFrame:
    """First source references of every discrepancy group."""
    codes = F.broadcast(catalogue(found.sparkSession, rules).select("finding_id", "code"))
    return first_refs(found.join(codes, "finding_id").select("code", "key", "ord", "source_ref"), ["code", "key"], shown)


def discrepancy_samples(f: DataFrame, rules: Rules = Rules(), shown: int = schema.SAMPLES_SHOWN) -> DataFrame:
    """First evidence samples per code."""
    codes = F.broadcast(catalogue(f.sparkSession, rules).select("finding_id", "code"))
    rows = row_checks(f, rules, with_evidence=True).filter("evidence IS NOT NULL").join(codes, "finding_id")
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy("ord"))).filter(F.col("rn") <= shown)
    return ranked.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ord", "evidence")))["evidence"].alias("samples"))


def duplicate_samples(f: DataFrame, shown: int = schema.SAMPLES_SHOWN) -> DataFrame:
    """(finding_id, key, samples): the first evidence of each duplicate group, one for each of its rows, as `group;number;rows` or `group;date;amount;rows`.

    A key's rows are first those of the party, or party name, that it met first. Rows are ranked within their own group, of which the first `shown` leave a task, and a
    key keeps the first few of its groups, so nothing but bounded lists is ever gathered."""
    ensure_checkpoint_dir(f.sparkSession)
    rows = numbered_rows(f).checkpoint()     # read four times
    same = rows.join(same_number_groups(rows), ["group", "party", "number"], "left_semi").withColumns({
        "finding_id": F.lit(25), "key": F.concat_ws("|", "group", "number"), "within": F.col("party"), "what": F.concat_ws(";", "group", "number")})
    amount = [F.col("invoice_date").cast("string"), F.col("doc_value").cast("string")]
    alike = rows.join(lookalike_groups(rows), ["group", "party_name", "invoice_date", "doc_value"], "left_semi").withColumns({
        "finding_id": F.lit(26), "key": F.concat_ws("|", "group", "party_name", *amount), "within": F.lit(""), "what": F.concat_ws(";", "group", *amount)})
    columns, by = ["finding_id", "key", "within", "what"], ["finding_id", "key", "within"]
    both = same.select(*columns, "ord", "source_ref").unionByName(alike.select(*columns, "ord", "source_ref"))
    ranked = both.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("ord", "source_ref"))).filter(F.col("rn") <= shown)
    refs = F.array_sort(F.collect_list(F.struct("ord", "source_ref")))
    groups = ranked.groupBy(*columns).agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies"), refs["source_ref"].alias("refs"))
    groups = groups.withColumn("rn", F.row_number().over(W.partitionBy("finding_id", "key").orderBy("first_ord", "within"))).filter(F.col("rn") <= shown)
    one = F.struct("first_ord", "within", "copies", F.concat_ws(";", "what", F.array_join("refs", ",")).alias("evidence"))
    every = F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.array_repeat(x["evidence"], x["copies"].cast("int"))))
    return groups.groupBy("finding_id", "key").agg(F.slice(every, 1, shown).alias("samples"))


def row_findings(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """source_ref -> all its findings; bounded by the number of checks, not by the data."""
    words = F.broadcast(catalogue(found.sparkSession, rules).select("finding_id", "code", "severity", "status"))
    entry = F.struct("severity_rank", "code", "severity", "status")
    ranked = found.join(words, "finding_id").withColumn("severity_rank", _rank(F.col("severity")))
    return ranked.groupBy("source_ref").agg(F.array_sort(F.collect_list(entry)).alias("findings"))


def _rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out


def missing_fields(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(field, required_for) rows recorded by the checks, with the first references."""
    rows = _needs(f, rules)
    counts = rows.groupBy("field", "required_for").agg(F.count(F.lit(1)).alias("rows_missing"))
    return counts.join(first_refs(rows, ["field", "required_for"]), ["field", "required_for"])


def missing_field_counts(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return _needs(f, rules).groupBy("field", "required_for").agg(F.count(F.lit(1)).alias("rows_missing"))


def _needs(f: DataFrame, rules: Rules) -> DataFrame:
    tests = checks(rules)
    by_need = {"invoice_number": tests[5], "invoice_date": tests[6], "supplier_gstin": tests[7],
               "taxable_value/supply": tests[11], "gst_rate": tests[19] | tests[20],
               "taxable_value/arithmetic": tests[21], "original_invoice_ref": tests[23]}
    names = F.array(*[F.when(test, name) for name, test in by_need.items()])
    rows = check_inputs(f, rules).select("ord", "source_ref", F.explode(names).alias("need")).filter("need IS NOT NULL")
    why = None
    for name, reason in NEEDS.items():
        why = F.when(F.col("need") == name, reason) if why is None else why.when(F.col("need") == name, reason)
    return rows.select("ord", "source_ref", F.split("need", "/")[0].alias("field"), why.alias("required_for"))


def row_summary(f: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row: category, document fields, counterparty, text amounts and the findings that touch it."""
    c = F.col
    empty = F.array().cast("array<struct<severity_rank:int,code:string,severity:string,status:string>>")
    side = F.when(c("group").isin("inward", "debit_notes", "expenses"), c("supplier_gstin")).otherwise(c("recipient_gstin"))
    return f.join(row_findings(found, rules), "source_ref", "left").select(
        "ord", "source_ref", "category", "score", "ambiguous", "group", "invoice_number", "invoice_date",
        c("party_name").alias("party"), side.alias("counterparty_gstin"), c("taxable").cast("string").alias("taxable_value"),
        c("tax").cast("string").alias("tax"), "currency", F.coalesce("findings", empty).alias("findings"))


def row_status(findings_col: Column) -> Column:
    """'issues' when any finding is HIGH, 'review' when any other counts, else 'none'."""
    worst = F.array_min(F.transform(findings_col, lambda x: x["severity_rank"]))
    return F.when(worst == 0, "issues").when(worst < SEVERITY_RANK["INFO"], "review").otherwise("none")


def recommended_actions(groups: DataFrame) -> DataFrame:
    """Distinct actions of HIGH and MEDIUM groups in the order a reader first meets them."""
    order = F.struct("severity_rank", "code", F.coalesce("first_ord", F.lit(-1).cast("bigint")))
    return groups.filter(F.col("severity").isin("HIGH", "MEDIUM")).groupBy("recommended_action") \
        .agg(F.min(order).alias("first_seen")).select("recommended_action", "first_seen")


def reviewer_concerns(concerns: DataFrame, f: DataFrame) -> DataFrame:
    """One finding for each existing row that reviewers (source_row, concern) doubt, however often they do."""
    doubted = concerns.select(F.col("source_row").alias("source_ref")).distinct()
    return f.select("ord", "source_ref").join(doubted, "source_ref", "left_semi").select("ord", "source_ref", F.lit(29).alias("finding_id"), F.lit("").alias("key"))


def with_concerns(found: DataFrame, concerns: DataFrame, f: DataFrame) -> DataFrame:
    """Findings and reviewer concerns together: a concern is a MEDIUM discrepancy, so status and readiness fall to REVIEW_REQUIRED."""
    return found.select("ord", "source_ref", "finding_id", "key").unionByName(reviewer_concerns(concerns, f))

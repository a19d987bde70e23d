import pytest
from pyspark.sql import functions as F

from tests.samples import BUSINESS, OTHER_STATE, gstin, purchase, sale, table
from voucherflow.functions.gstin import gstin_status
from voucherflow.operators import accounting as A
from voucherflow.operators import filing as FI
from voucherflow.operators import validation as V
from voucherflow.operators.features import features
from voucherflow.operators.normalize import normalize


def book(spark, *rows):
    raw = table(spark, list(rows))
    kinds = raw.select("source_ref", F.regexp_replace("Kind", r"\?$", "").alias("category"), F.lit(0.9).alias("score"),
                       F.col("Kind").endswith("?").alias("ambiguous"))
    return features(normalize(raw.drop("Kind")), business_gstin=BUSINESS, classifications=kinds)


def figures(f):
    return {r["name"]: (r["value"], r["status"], r["rows_included"], r["rows_missing"]) for r in A.calculations(f).collect()}


def codes(f):
    return {r["code"] for r in V.discrepancies(V.findings(f), V.books_findings(f, business_gstin=BUSINESS)).collect()}


def run_verdict(f):
    found = V.discrepancies(V.findings(f), V.books_findings(f, business_gstin=BUSINESS, ledgers=A.ledger_balances(f)))
    return FI.verdict(f, found, A.calculations(f)).first()


def test_clean_pair(spark):
    f = book(spark, sale(), purchase())
    got = figures(f)
    assert len(got) == 43
    assert got["outward_total_tax"][:2] == ("1800.00", "COMPLETE")
    assert got["itc_tax_with_basic_evidence"][:2] == ("900.00", "COMPLETE")
    assert got["potential_net_gst_liability"][:2] == ("900.00", "COMPLETE")
    assert got["credit_notes_total_tax"][:2] == ("0.00", "NOT_APPLICABLE")
    assert codes(f) == {"ITC_NOT_RECONCILED_EXTERNALLY"}
    assert V.missing_field_counts(f).count() == 0
    v = run_verdict(f)
    assert (v["report_status"], v["readiness"]) == ("ANALYSIS_COMPLETE", "PREPARED_FOR_PROFESSIONAL_REVIEW")


def test_rounding_after_summation(spark):
    f = book(spark, *[sale(**{"Invoice No": f"S-{i}", "Taxable Value": "0.005", "CGST": None, "SGST": None}) for i in range(3)])
    assert figures(f)["outward_taxable_value"][0] == "0.02"


def test_missing_values_are_not_estimated(spark):
    bare = {"CGST": None, "SGST": None}
    one = figures(book(spark, sale(**bare, **{"Tax Amount": "18"}), sale(**bare, **{"Invoice No": "S-2"})))
    assert one["outward_total_tax"] == ("18.00", "INCOMPLETE", 1, 1)
    none = figures(book(spark, sale(**bare)))
    assert none["outward_total_tax"][:2] == (None, "UNRESOLVED")


def test_purchase_without_gstin(spark):
    f = book(spark, sale(), purchase(**{"Supplier GSTIN": None, "CGST": "90", "SGST": "90"}))
    got = figures(f)
    assert got["itc_tax_with_basic_evidence"][:2] == ("0.00", "NOT_APPLICABLE")
    assert got["itc_tax_without_basic_evidence"][0] == "180.00"
    v = run_verdict(f)
    assert (v["report_status"], v["readiness"]) == ("REVIEW_REQUIRED", "NOT_READY")


def test_ambiguous_purchase(spark):
    got = figures(book(spark, sale(), purchase(Kind="Purchase?")))
    assert got["itc_tax_with_basic_evidence"][:2] == ("900.00", "INCOMPLETE")
    assert got["potential_net_gst_liability"][1] == "INCOMPLETE"
    assert got["outward_total_tax"][1] == "COMPLETE"


def test_foreign_currency_is_left_out(spark):
    f = book(spark, sale(), sale(**{"Invoice No": "S-9", "Currency": "usd"}))
    assert A.summary_counts(f).first()["rows_excluded_foreign_currency"] == 1
    assert figures(f)["outward_taxable_value"][0] == "10000.00"
    assert "FOREIGN_CURRENCY_EXCLUDED" in codes(f)


def test_receipt_and_ledger(spark):
    got = figures(book(spark, {"Kind": "Receipt", "Received Amount": "5000"}))
    assert got["receipts_amount"][0] == "5000.00" and got["outward_total_tax"][1] == "NOT_APPLICABLE"
    f = book(spark, {"Kind": "Journal", "Ledger": "Bank", "Opening Balance": "100", "Debit": "50", "Credit": "20", "Closing Balance": "130"})
    assert A.ledger_balances(f).first()["reconciles"] is True
    assert run_verdict(f)["report_status"] == "INSUFFICIENT_DATA"


@pytest.mark.parametrize("change, wanted", [
    ({"CGST": "900", "SGST": "800", "Integrated Tax": "100"}, {"CGST_SGST_UNEQUAL", "IGST_WITH_CGST_SGST"}),
    ({"CGST": "950", "SGST": "950"}, {"TAX_AMOUNT_MISMATCH"}),
    ({"GST Rate": "17"}, {"UNSUPPORTED_TAX_RATE"}),
    ({"Invoice Value": "12000"}, {"INVOICE_TOTAL_UNRECONCILED"}),
    ({"GST Rate": None}, {"TAX_RATE_MISSING"}),
    ({"GST Rate": None, "CGST": "520", "SGST": "520"}, {"IMPLIED_TAX_RATE_UNUSUAL"}),
    ({"Tax Amount": "1000"}, {"TAX_COMPONENTS_DO_NOT_SUM"}),
    ({"Invoice No": None}, {"INVOICE_NUMBER_MISSING"}),
    ({"Invoice Date": None}, {"INVOICE_DATE_MISSING"}),
    ({"Taxable Value": None}, {"TAXABLE_VALUE_MISSING"}),
    ({"Customer GSTIN": None}, {"RECIPIENT_GSTIN_MISSING"}),
    ({"Customer GSTIN": "27AAPFU0939F1ZX"}, {"RECIPIENT_GSTIN_INVALID"}),
    ({"Customer GSTIN": OTHER_STATE}, {"TAX_TYPE_STATE_MISMATCH"}),
    ({"Kind": "Journal"}, {"TAX_ON_NON_TAX_DOCUMENT"}),
    ({"Kind": "Sales?"}, {"AMBIGUOUS_CLASSIFICATION"}),
    ({"Kind": "Sales Return / Credit Note"}, {"NOTE_WITHOUT_ORIGINAL_INVOICE"}),
    ({"Taxable Value": None, "CGST": None, "SGST": None}, {"SUPPLY_VALUE_MISSING"}),
])
def test_each_check_fires(spark, change, wanted):
    assert wanted <= codes(book(spark, sale(**change)))


def test_duplicates_merge_across_suppliers(spark):
    other = gstin("27", "AAACX1111Q")
    f = book(spark, sale(), sale(), purchase(), purchase(**{"Invoice No": "P-78"}),
             purchase(**{"Invoice No": "D1", "Invoice Date": "2026-01-01"}), purchase(**{"Invoice No": "D1", "Invoice Date": "2026-01-02"}),
             purchase(**{"Invoice No": "D1", "Supplier GSTIN": other, "Invoice Date": "2026-01-03"}),
             purchase(**{"Invoice No": "D1", "Supplier GSTIN": other, "Invoice Date": "2026-01-04"}))
    rows = {(r["code"], r["key"]): r["affected_rows"] for r in V.discrepancies(V.findings(f)).collect()}
    assert rows[("DUPLICATE_INVOICE_NUMBER", "outward|S-001")] == 2
    assert rows[("DUPLICATE_INVOICE_NUMBER", "inward|D1")] == 4
    assert any(code == "POSSIBLE_DUPLICATE_DOCUMENT" for code, _ in rows)


def test_business_gstin(spark):
    f = book(spark, sale())
    bad = V.discrepancies(V.findings(f), V.books_findings(f, business_gstin="27AAPFU0939F1ZX")).filter("code = 'BUSINESS_GSTIN_INVALID'").first()
    assert "invalid_checksum" in bad["message"]


def test_gstin_statuses(spark):
    rows = spark.createDataFrame([("27AAPFU0939F1ZV",), ("27AAPFU0939F1ZX",), ("27AAPFU0939F",), (None,)], "g string")
    assert [r[0] for r in rows.select(gstin_status(F.col("g"))).collect()] == ["valid", "invalid_checksum", "invalid_format", "missing"]


def test_shown_references_are_limited_before_the_shuffle(spark, folder):
    from voucherflow.plans.gst import feats
    plan = V.discrepancy_refs(V.findings(feats(spark, folder)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_filing_rate_text_keeps_buckets_apart(spark):
    bare = {"Customer GSTIN": None}
    f = book(spark, sale(**bare), sale(**bare, **{"Invoice No": "S-2", "GST Rate": "18.0"}), sale(**bare, **{"Invoice No": "S-3", "GST Rate": None}))
    keys = {r["rate_key"] for r in FI.filing_sections(f).filter(F.col("section") == FI.BY_RATE).collect()}
    assert keys == {"18", "18.0", "rate not stated"}

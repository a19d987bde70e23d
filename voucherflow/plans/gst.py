"""Queries over the books: features, figures, filing, ledgers and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.config import Rules
from voucherflow.functions.gstin import gstin_status
from voucherflow.operators import accounting as A
from voucherflow.operators import features as FE
from voucherflow.operators import filing as FI
from voucherflow.operators import validation as V
from voucherflow.operators.ranking import overall_rank
from voucherflow.plans.ctes import cte, gstin_status_sql, lit, money, with_
from voucherflow.plans.registry import query
from voucherflow.sources import tables as T

RULES = Rules()


def feats(spark, sf):
    return FE.features(T.books(spark, sf), RULES, T.business_gstin())


def _txt(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


# ---------------------------------------------------------------- features
@query("derived_books", with_("books", """
SELECT ord, source_ref, category, ambiguous, currency, CAST(taxable_value AS VARCHAR) AS taxable_value,
 CAST(gst_rate AS VARCHAR) AS gst_rate, gst_rate_text, CAST(cgst AS VARCHAR) AS cgst, CAST(sgst AS VARCHAR) AS sgst,
 CAST(igst AS VARCHAR) AS igst, CAST(cess AS VARCHAR) AS cess, CAST(total_tax AS VARCHAR) AS total_tax,
 CAST(total_amount AS VARCHAR) AS total_amount, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date,
 party_gstin, supplier_name, customer_name, original_invoice_ref, ledger,
 CAST(closing_balance AS VARCHAR) AS closing_balance, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit
FROM books"""))
def derived_books(spark, sf):
    return T.books(spark, sf).select(
        "ord", "source_ref", "category", "ambiguous", "currency",
        *_txt("taxable_value", "gst_rate"), "gst_rate_text",
        *_txt("cgst", "sgst", "igst", "cess", "total_tax", "total_amount"), "invoice_number", *_txt("invoice_date"),
        "party_gstin", "supplier_name", "customer_name", "original_invoice_ref", "ledger",
        *_txt("closing_balance", "debit", "credit"))


@query("fea_01", with_("features", "SELECT grp, category, count(*) AS n_rows FROM features GROUP BY ALL"))
def fea_01(spark, sf):
    return feats(spark, sf).groupBy(F.col("group").alias("grp"), "category").agg(F.count(F.lit(1)).alias("n_rows"))


_PRESENT_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in sorted(schema.COMPONENTS)) + ")"


@query("fea_02", with_("features", f"SELECT source_ref, {_PRESENT_SQL} AS present, {money('tax')} AS tax FROM features"))
def fea_02(spark, sf):
    return feats(spark, sf).select("source_ref", F.array_join(FE.components_present(), ",").alias("present"),
                                   A.cents(F.col("tax")).cast("string").alias("tax"))


@query("fea_03", with_("features", "SELECT source_ref, supplier_gstin, recipient_gstin, party_name FROM features"))
def fea_03(spark, sf):
    return feats(spark, sf).select("source_ref", "supplier_gstin", "recipient_gstin", "party_name")


@query("fea_04", with_("features", "SELECT currency, currency_stated, in_base_currency, count(*) AS n_rows FROM features GROUP BY ALL"))
def fea_04(spark, sf):
    return feats(spark, sf).groupBy("currency", "currency_stated", "in_base_currency").agg(F.count(F.lit(1)).alias("n_rows"))


@query("fea_05", with_("books", f"SELECT source_ref, party_gstin, {gstin_status_sql('party_gstin')} AS gstin_status FROM books"))
def fea_05(spark, sf):
    return T.books(spark, sf).select("source_ref", "party_gstin", gstin_status(F.col("party_gstin")).alias("gstin_status"))


@query("fea_06", with_("features", "SELECT source_ref, has_itc_evidence FROM features"))
def fea_06(spark, sf):
    return feats(spark, sf).select("source_ref", "has_itc_evidence")


_FEAT_TEXT = ("taxable", "rate", "cgst", "sgst", "igst", "cess", "reported_total_tax", "tax", "total_amount", "amount",
              "invoice_date", "opening_balance", "closing_balance", "debit", "credit")
_FEAT_PLAIN = ("ord", "source_ref", "category", "ambiguous", "score", "currency", "currency_stated", "in_base_currency",
               "rate_text", "n_components", "invoice_number", "supplier_gstin", "recipient_gstin",
               "supplier_gstin_status", "recipient_gstin_status", "party_name", "original_invoice_ref", "ledger",
               "has_itc_evidence")


@query("fea_07", with_("features", "SELECT grp, " + ", ".join(_FEAT_PLAIN) + ", " + ", ".join(
    (money(n) if n == "tax" else f"CAST({n} AS VARCHAR)") + f" AS {n}" for n in _FEAT_TEXT) + " FROM features"))
def fea_07(spark, sf):
    tx = T.books(spark, sf)
    cls = tx.select("source_ref", "category", "score", "ambiguous")
    f = FE.features(tx, RULES, T.business_gstin(), cls)
    return f.select(F.col("group").alias("grp"), *_FEAT_PLAIN, *[
        (A.cents(F.col(n)) if n == "tax" else F.col(n)).cast("string").alias(n) for n in _FEAT_TEXT])


# ---------------------------------------------------------------- figures
def _calc_arm(name, where, value):
    return (f"SELECT {lit(name)} AS name, count(*) AS n, count({value}) AS have, "
            f"count(CASE WHEN ambiguous AND ({value}) IS NOT NULL THEN 1 END) AS amb, round(sum({value}), 2) AS total "
            f"FROM base WHERE {where}")


def _calc_arms():
    out = []
    for g in schema.GROUPS:
        if g in ("receipts", "payments"):
            out.append(_calc_arm(f"{g}_amount", f"grp = '{g}'", "coalesce(total_amount, amount)"))
        else:
            out.append(_calc_arm(f"{g}_taxable_value", f"grp = '{g}'", "taxable"))
            out.append(_calc_arm(f"{g}_document_value", f"grp = '{g}'", "coalesce(total_amount, amount)"))
    for g in schema.TAX_GROUPS:
        for part in schema.COMPONENTS:
            out.append(_calc_arm(f"{g}_{part}", f"grp = '{g}' AND n_components > 0", f"coalesce({part}, 0)"))
        out.append(_calc_arm(f"{g}_total_tax", f"grp = '{g}'", "tax"))
    itc = "category IN ('Purchase', 'Import', 'Expense')"
    out.append(_calc_arm("itc_tax_with_basic_evidence", f"{itc} AND has_itc_evidence", "tax"))
    out.append(_calc_arm("itc_tax_without_basic_evidence", f"{itc} AND NOT has_itc_evidence AND tax > 0", "tax"))
    out.append(_calc_arm("zero_tax_value", "grp IN ('outward', 'inward') AND taxable IS NOT NULL AND (coalesce(rate = 0, false) OR coalesce(tax = 0, false))", "taxable"))
    return " UNION ALL ".join(out)


cte("base", ("features",), "SELECT * FROM features WHERE in_base_currency")
cte("sums", ("base",), _calc_arms())
cte("plain_calcs", ("sums",), """
SELECT name, CASE WHEN n = 0 THEN CAST(0 AS DECIMAL(28,2)) ELSE CAST(total AS DECIMAL(28,2)) END AS amount,
 CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN have = 0 THEN 'UNRESOLVED' WHEN have < n OR amb > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
 have AS rows_included, n - have AS rows_missing, amb FROM sums""")


def _combo(name, plus, minus, source):
    pick = f"FROM {source} WHERE name IN ('{plus}', '{minus}')"
    return (f"SELECT '{name}' AS name, CASE WHEN count_if(status = 'UNRESOLVED') > 0 THEN NULL ELSE CAST(round(sum(CASE WHEN name = '{plus}' "
            f"THEN coalesce(amount, 0) ELSE -coalesce(amount, 0) END), 2) AS DECIMAL(28,2)) END AS amount, "
            f"CASE WHEN bool_and(status = 'NOT_APPLICABLE') THEN 'NOT_APPLICABLE' WHEN bool_or(status = 'UNRESOLVED') THEN 'UNRESOLVED' "
            f"WHEN bool_or(status = 'INCOMPLETE') THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, "
            f"CAST(sum(rows_included) AS BIGINT) AS rows_included, CAST(sum(rows_missing) AS BIGINT) AS rows_missing, CAST(0 AS BIGINT) AS amb {pick}")


cte("combos1", ("plain_calcs",),
    _combo("output_tax_after_credit_notes", "outward_total_tax", "credit_notes_total_tax", "plain_calcs") + " UNION ALL "
    + _combo("potential_itc_after_debit_notes", "itc_tax_with_basic_evidence", "debit_notes_total_tax", "plain_calcs"))
cte("combos2", ("combos1",), _combo("potential_net_gst_liability", "output_tax_after_credit_notes",
                                    "potential_itc_after_debit_notes", "combos1"))
cte("calcs", ("combos2", "combos1", "plain_calcs", "sums"), """
SELECT name, CAST(amount AS VARCHAR) AS value, CASE WHEN name = 'potential_net_gst_liability' AND status = 'COMPLETE'
 AND (SELECT n FROM sums WHERE name = 'itc_tax_without_basic_evidence') > 0 THEN 'INCOMPLETE' ELSE status END AS status,
 rows_included, rows_missing, CASE WHEN name IN (""" + ", ".join(lit(n) for n in A.ACCOUNTING_NAMES) + """) THEN 'accounting' ELSE 'gst' END AS section
FROM (SELECT * FROM plain_calcs UNION ALL SELECT * FROM combos1 UNION ALL SELECT * FROM combos2)""")


def _calcs(spark, sf):
    return A.calculations(feats(spark, sf), RULES)


def _calc_query(key, where):
    @query(key, with_("calcs", f"SELECT name, value, status, rows_included, rows_missing FROM calcs WHERE {where}"))
    def run(spark, sf):
        return _calcs(spark, sf).filter(where).select("name", "value", "status", "rows_included", "rows_missing")
    return run


_calc_query("acc_03", "section = 'accounting'")
_calc_query("acc_04", "name LIKE '%total_tax' OR name LIKE '%gst' OR name LIKE '%cess'")
_calc_query("acc_05", "name = 'output_tax_after_credit_notes'")
_calc_query("acc_06", "name IN ('itc_tax_with_basic_evidence', 'itc_tax_without_basic_evidence')")
_calc_query("acc_07", "name = 'potential_itc_after_debit_notes'")
_calc_query("acc_08", "name = 'potential_net_gst_liability'")
_calc_query("acc_09", "name = 'zero_tax_value'")


@query("acc_calculations", with_("calcs", "SELECT name, value, status, rows_included, rows_missing, section FROM calcs"))
def acc_calculations(spark, sf):
    return _calcs(spark, sf).select("name", "value", "status", "rows_included", "rows_missing", "section")


@query("acc_01", with_("base", """
SELECT grp, CAST(count(*) AS BIGINT) AS n_rows, count(tax) AS rows_included, """ + money("sum(tax)") + """ AS value,
 count(CASE WHEN tax IS NOT NULL AND ambiguous THEN 1 END) AS ambiguous_rows,
 array_to_string(list_slice(list(source_ref ORDER BY ord) FILTER (tax IS NOT NULL), 1, 50), ',') AS source_refs
FROM base WHERE grp IN ('outward', 'inward', 'credit_notes', 'debit_notes', 'expenses') GROUP BY grp"""))
def acc_01(spark, sf):
    f = feats(spark, sf)
    sums = A.group_sums(f, RULES).filter(F.col("group").isin(*schema.TAX_GROUPS))
    refs = A.calculation_refs(f, RULES).withColumn("group", F.regexp_extract("name", "^(.*)_total_tax$", 1))
    return sums.join(refs.filter("group <> ''"), "group").select(
        F.col("group").alias("grp"), F.col("total_tax__n").alias("n_rows"), F.col("total_tax__have").alias("rows_included"),
        A.cents(F.col("total_tax__sum")).cast("string").alias("value"), F.col("total_tax__amb").alias("ambiguous_rows"),
        F.array_join("source_refs", ",").alias("source_refs"))


@query("acc_02", with_("calcs", "SELECT name, value, status, rows_included, rows_missing FROM calcs WHERE name IN "
                                "('output_tax_after_credit_notes', 'potential_itc_after_debit_notes', 'potential_net_gst_liability')"))
def acc_02(spark, sf):
    return _calcs(spark, sf).filter(F.col("name").isin(
        "output_tax_after_credit_notes", "potential_itc_after_debit_notes", "potential_net_gst_liability")).select(
        "name", "value", "status", "rows_included", "rows_missing")


@query("acc_10", with_("features", """
SELECT 'total' AS measure, 'transaction_count' AS item, count(*) AS n_rows FROM features
UNION ALL SELECT 'total', 'rows_in_base_currency', count_if(in_base_currency) FROM features
UNION ALL SELECT 'total', 'rows_excluded_foreign_currency', count_if(NOT in_base_currency) FROM features
UNION ALL SELECT 'total', 'rows_with_assumed_base_currency', count_if(in_base_currency AND NOT currency_stated) FROM features
UNION ALL SELECT 'category', coalesce(category, 'Unclassified'), count(*) FROM features GROUP BY 2
UNION ALL SELECT 'group', g, (SELECT count(*) FROM features WHERE in_base_currency AND grp = g)
 FROM (SELECT unnest(['outward', 'inward', 'credit_notes', 'debit_notes', 'receipts', 'payments', 'expenses', 'other']) AS g)"""))
def acc_10(spark, sf):
    f = feats(spark, sf)
    totals = A.summary_counts(f)
    tall = totals.select(F.explode(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(n).alias("item"),
                                                      F.col(n).alias("n_rows")) for n in totals.columns])).alias("e")).select("e.*")
    cats = A.counts_by_category(f).select(F.lit("category").alias("measure"), F.col("category").alias("item"), "n_rows")
    groups = A.counts_by_group(f).select(F.lit("group").alias("measure"), F.col("group").alias("item"), "n_rows")
    return tall.unionByName(cats).unionByName(groups)


# ---------------------------------------------------------------- ledgers and filing
cte("ledgers", ("base",), """
SELECT *, expected = closing AS reconciles FROM (SELECT ledger, round(sum(coalesce(opening_balance, 0)), 2) AS opening,
 round(sum(coalesce(debit, 0)), 2) AS debits, round(sum(coalesce(credit, 0)), 2) AS credits,
 round(sum(coalesce(opening_balance, 0)) + sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)), 2) AS expected,
 round(sum(closing_balance), 2) AS closing, count(*) AS n_rows FROM base
 WHERE coalesce(ledger, '') <> '' AND (opening_balance IS NOT NULL OR closing_balance IS NOT NULL) GROUP BY ledger)""")


@query("led_01", with_("ledgers", f"""
SELECT ledger, {money('opening')} AS opening, {money('debits')} AS debits, {money('credits')} AS credits,
 {money('closing')} AS closing_reported, {money('expected')} AS closing_computed, reconciles, n_rows FROM ledgers"""))
def led_01(spark, sf):
    out = A.ledger_balances(feats(spark, sf))
    return out.select("ledger", *_txt("opening", "debits", "credits", "closing_reported", "closing_computed"),
                      "reconciles", "n_rows")


@query("acc_11", with_("calcs ledgers", """
SELECT name, status, rows_included, rows_missing FROM calcs UNION ALL
SELECT 'ledger_balance:' || ledger, CASE WHEN reconciles THEN 'COMPLETE' WHEN reconciles IS NULL THEN 'UNRESOLVED' ELSE 'INCOMPLETE' END,
 n_rows, 0 FROM ledgers"""))
def acc_11(spark, sf):
    f = feats(spark, sf)
    return A.calculation_checks(A.calculations(f, RULES), A.ledger_balances(f))


_SECTION_SQL = ("CASE WHEN grp = 'outward' THEN CASE WHEN category = 'Export' THEN 'exports' WHEN recipient_gstin_status = 'valid' THEN 'outward_b2b' "
                "ELSE 'outward_without_valid_recipient_gstin' END WHEN grp IN ('inward', 'expenses') THEN CASE WHEN has_itc_evidence "
                "THEN 'inward_with_basic_itc_evidence' ELSE 'inward_without_basic_itc_evidence' END "
                "WHEN grp IN ('credit_notes', 'debit_notes') THEN grp END")
_READY_SQL = ("coalesce(invoice_number, '') <> '' AND invoice_date IS NOT NULL AND CASE section "
              "WHEN 'outward_b2b' THEN coalesce(recipient_gstin, '') <> '' AND taxable IS NOT NULL AND tax IS NOT NULL "
              "WHEN 'exports' THEN taxable IS NOT NULL "
              "WHEN 'outward_without_valid_recipient_gstin' THEN taxable IS NOT NULL AND tax IS NOT NULL "
              "WHEN 'credit_notes' THEN coalesce(original_invoice_ref, '') <> '' AND tax IS NOT NULL "
              "WHEN 'debit_notes' THEN coalesce(original_invoice_ref, '') <> '' AND tax IS NOT NULL "
              "ELSE coalesce(supplier_gstin, '') <> '' AND tax IS NOT NULL END")
cte("sectioned", ("base",), f"SELECT *, {_SECTION_SQL} AS section FROM base")
cte("filing", ("sectioned",), f"""
SELECT section, CASE WHEN section = 'outward_without_valid_recipient_gstin' THEN coalesce(rate_text, 'rate not stated') ELSE '' END AS rate_key,
 count(*) AS n_rows, {money('sum(taxable)')} AS taxable_value, {money('sum(tax)')} AS tax,
 CASE WHEN bool_and({_READY_SQL}) THEN 'PREPARED_FOR_REVIEW' ELSE 'INCOMPLETE' END AS status FROM sectioned WHERE section IS NOT NULL GROUP BY 1, 2""")
_ALL_SECTIONS = ", ".join(f"('{n}')" for n in FI.REQUIRED)


@query("fil_01", with_("filing", f"""
SELECT n.section, coalesce(f.rate_key, '') AS rate_key, coalesce(f.n_rows, 0) AS n_rows, f.taxable_value, f.tax, coalesce(f.status, 'NO_DATA') AS status
FROM (VALUES {_ALL_SECTIONS}) AS n(section) LEFT JOIN filing f USING (section) WHERE n.section <> 'outward_without_valid_recipient_gstin'"""))
def fil_01(spark, sf):
    return FI.filing_sections(feats(spark, sf)).filter(F.col("section") != FI.BY_RATE)


@query("fil_02", with_("filing", "SELECT section, rate_key, n_rows, taxable_value, tax, status FROM filing"))
def fil_02(spark, sf):
    return FI.filing_sections(feats(spark, sf)).filter("n_rows > 0")


# ---------------------------------------------------------------- findings
_SLABS = ", ".join(schema.RATE_SLABS)
_INV = "grp IN ('outward', 'inward', 'credit_notes', 'debit_notes')"
_DOC = f"in_base_currency AND ({_INV} OR grp = 'expenses')"
_SUP = f"{_DOC} AND (grp IN ('inward', 'debit_notes') OR (grp = 'expenses' AND coalesce(tax, 0) > 0))"
_REC = f"{_DOC} AND grp IN ('outward', 'credit_notes') AND category <> 'Export'"
_VALID2 = "supplier_gstin_status = 'valid' AND recipient_gstin_status = 'valid' AND n_components > 0"
_LOCAL = "(coalesce(cgst, 0) > 0 OR coalesce(sgst, 0) > 0)"
_UNRATED = f"{_DOC} AND taxable IS NOT NULL AND tax IS NOT NULL AND rate IS NULL AND taxable > 0"
# implied rate to two places, by exact integer arithmetic on paise
_TP = "CAST(round(tax * 100, 0) AS HUGEINT)"
_XP = "CAST(round(taxable * 100, 0) AS HUGEINT)"
_IMPLIED = f"((2 * {_TP} * 10000 + {_XP}) // (2 * {_XP}))"   # hundredths of a percent, half up
_IS_NEAR = "(" + " OR ".join(f"abs({_IMPLIED} - {int(float(s) * 100)}) <= 25" for s in schema.RATE_SLABS) + ")"
_EXPECTED = "CAST(round(taxable * rate * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(28,2))"

SQL_CHECKS = {
    2: "NOT in_base_currency",
    3: "in_base_currency AND ambiguous",
    4: "in_base_currency AND grp = 'other' AND (coalesce(tax, 0) > 0 OR n_components > 0)",
    5: f"{_DOC} AND {_INV} AND coalesce(invoice_number, '') = ''",
    6: f"{_DOC} AND {_INV} AND invoice_date IS NULL",
    7: f"{_SUP} AND supplier_gstin_status = 'missing'",
    8: f"{_SUP} AND supplier_gstin_status NOT IN ('missing', 'valid')",
    9: f"{_REC} AND recipient_gstin_status = 'missing'",
    10: f"{_REC} AND recipient_gstin_status NOT IN ('missing', 'valid')",
    11: f"{_DOC} AND {_INV} AND taxable IS NULL AND tax IS NULL",
    12: f"{_DOC} AND abs(cgst - sgst) > 1.00",
    13: f"{_DOC} AND coalesce(igst, 0) > 0 AND {_LOCAL}",
    14: f"{_DOC} AND n_components > 0 AND abs(tax - reported_total_tax) > 1.00",
    15: f"{_DOC} AND {_VALID2} AND substr(supplier_gstin, 1, 2) <> substr(recipient_gstin, 1, 2) AND {_LOCAL}",
    16: f"{_DOC} AND {_VALID2} AND substr(supplier_gstin, 1, 2) = substr(recipient_gstin, 1, 2) AND coalesce(igst, 0) > 0",
    17: f"{_DOC} AND rate IS NOT NULL AND rate NOT IN ({_SLABS})",
    18: f"{_DOC} AND abs({_EXPECTED} - tax) > 1.00",
    19: f"{_UNRATED} AND {_IS_NEAR}",
    20: f"{_UNRATED} AND NOT {_IS_NEAR}",
    21: f"{_DOC} AND coalesce(tax, 0) > 0 AND taxable IS NULL",
    22: f"{_DOC} AND abs(round(taxable + tax, 2) - total_amount) > 1.00",
    23: f"{_DOC} AND grp IN ('credit_notes', 'debit_notes') AND coalesce(original_invoice_ref, '') = ''",
    24: f"{_DOC} AND category IN ('Purchase', 'Import', 'Expense') AND coalesce(tax, 0) > 0 AND NOT has_itc_evidence",
}
_CODE_BY_ID = {i: f.code for i, f in V.CATALOGUE.items()}
VAL_KEYS = {2: "val_02", 3: "val_03", 4: "val_04", 5: "val_05", 6: "val_06", 7: "val_07", 8: "val_08", 9: "val_09",
            10: "val_10", 11: "val_11", 12: "val_12", 13: "val_13", 14: "val_14", 17: "val_16", 18: "val_17",
            19: "val_18", 20: "val_19", 21: "val_20", 22: "val_21", 23: "val_22", 24: "val_23"}

cte("numbered", ("base",), f"""
SELECT *, upper(trim(invoice_number)) AS number, CASE WHEN grp IN ('outward', 'credit_notes') THEN ''
 ELSE coalesce(nullif(supplier_gstin, ''), lower(trim(coalesce(party_name, '')))) END AS party,
 lower(trim(coalesce(party_name, ''))) AS pname, CAST(round(coalesce(total_amount, taxable), 2) AS DECIMAL(28,2)) AS doc_value
FROM base WHERE {_INV} AND coalesce(invoice_number, '') <> ''""")
cte("dup_number", ("numbered",), """
SELECT ord, source_ref, 'DUPLICATE_INVOICE_NUMBER' AS code, grp || '|' || number AS key
FROM (SELECT *, count(*) OVER (PARTITION BY grp, party, number) AS n FROM numbered) WHERE n > 1""")
cte("dup_document", ("numbered",), """
SELECT ord, source_ref, 'POSSIBLE_DUPLICATE_DOCUMENT' AS code,
 grp || '|' || pname || '|' || CAST(invoice_date AS VARCHAR) || '|' || CAST(doc_value AS VARCHAR) AS key
FROM numbered JOIN (SELECT grp, pname, invoice_date, doc_value FROM numbered WHERE doc_value IS NOT NULL AND invoice_date IS NOT NULL
 GROUP BY ALL HAVING count(DISTINCT number) > 1) USING (grp, pname, invoice_date, doc_value)""")
cte("found", ("features", "dup_number", "dup_document"), " UNION ALL ".join(
    f"SELECT ord, source_ref, '{_CODE_BY_ID[i]}' AS code, '' AS key, '{V.CATALOGUE[i].severity}' AS severity, '{V.CATALOGUE[i].status}' AS status, {i} AS variant FROM features WHERE {cond}"
    for i, cond in SQL_CHECKS.items()) + """
 UNION ALL SELECT ord, source_ref, code, key, 'HIGH', 'CONFIRMED', 25 FROM dup_number
 UNION ALL SELECT ord, source_ref, code, key, 'MEDIUM', 'POSSIBLE', 26 FROM dup_document""")


def _one_check(finding_id):
    def run(spark, sf):
        f = V.check_inputs(feats(spark, sf), RULES)
        return f.filter(V.checks(RULES)[finding_id]).select("source_ref", F.lit(_CODE_BY_ID[finding_id]).alias("code"))
    return run


for _i, _key in VAL_KEYS.items():
    query(_key, with_("features", f"SELECT source_ref, '{_CODE_BY_ID[_i]}' AS code FROM features WHERE {SQL_CHECKS[_i]}"))(_one_check(_i))


@query("val_01", with_("books", f"""
SELECT 'BUSINESS_GSTIN_INVALID' AS code, gstin_status AS detail, count(*) AS n_rows
FROM (SELECT {gstin_status_sql("upper(replace(party_gstin, ' ', ''))")} AS gstin_status FROM books WHERE party_gstin IS NOT NULL)
WHERE gstin_status <> 'valid' GROUP BY ALL"""))
def val_01(spark, sf):
    """The business-GSTIN check applied to every supplied number of the table."""
    given = T.books(spark, sf).filter("party_gstin IS NOT NULL").select(
        F.upper(F.regexp_replace("party_gstin", " ", "")).alias("gstin"))
    rows = FE.once(FE.once(given, {"g": F.col("gstin")}), {"detail": gstin_status(F.col("g"))})
    return rows.filter("detail <> 'valid'").groupBy(F.lit("BUSINESS_GSTIN_INVALID").alias("code"), "detail") \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@query("val_15", with_("features", f"""
SELECT source_ref, 'TAX_TYPE_STATE_MISMATCH' AS code, CASE WHEN {SQL_CHECKS[15]} THEN 'inter' ELSE 'intra' END AS kind
FROM features WHERE ({SQL_CHECKS[15]}) OR ({SQL_CHECKS[16]})"""))
def val_15(spark, sf):
    tests = V.checks(RULES)
    return V.check_inputs(feats(spark, sf), RULES).filter(tests[15] | tests[16]).select(
        "source_ref", F.lit("TAX_TYPE_STATE_MISMATCH").alias("code"), F.when(tests[15], "inter").otherwise("intra").alias("kind"))


@query("val_24", with_("dup_number", "SELECT source_ref, code, key FROM dup_number"))
def val_24(spark, sf):
    return V.duplicate_findings(feats(spark, sf)).filter("finding_id = 25").select(
        "source_ref", F.lit("DUPLICATE_INVOICE_NUMBER").alias("code"), "key")


_COPIES = """SELECT * FROM numbered UNION ALL
SELECT * REPLACE (ord + 1000000000 AS ord, source_ref || 'b' AS source_ref, number || '-B' AS number) FROM numbered WHERE ord % 97 < 3"""
cte("copied", ("numbered",), _COPIES)
cte("alike", ("copied",), """
SELECT ord, source_ref, 'POSSIBLE_DUPLICATE_DOCUMENT' AS code, grp, number, invoice_date, doc_value,
 grp || '|' || pname || '|' || CAST(invoice_date AS VARCHAR) || '|' || CAST(doc_value AS VARCHAR) AS key
FROM copied JOIN (SELECT grp, pname, invoice_date, doc_value FROM copied WHERE doc_value IS NOT NULL AND invoice_date IS NOT NULL
 GROUP BY ALL HAVING count(DISTINCT number) > 1) USING (grp, pname, invoice_date, doc_value)""")


def copied_feats(spark, sf):
    """The sample books, and some of their rows again under another number."""
    f = feats(spark, sf)
    again = f.filter("ord % 97 < 3 AND invoice_number <> ''").withColumns({
        "ord": F.col("ord") + 1_000_000_000, "source_ref": F.concat("source_ref", F.lit("b")), "invoice_number": F.concat(F.upper(F.trim("invoice_number")), F.lit("-B"))})
    return f.unionByName(again)


@query("val_25", with_("alike", "SELECT source_ref, code, key FROM alike"))
def val_25(spark, sf):
    """Lookalikes in books where some documents come again under another number."""
    return V.duplicate_findings(copied_feats(spark, sf)).filter("finding_id = 26").select(
        "source_ref", F.lit("POSSIBLE_DUPLICATE_DOCUMENT").alias("code"), "key")


@query("val_30_samples", with_("copied alike", """
, g AS (SELECT 25 AS finding_id, grp || '|' || number AS key, party AS within, min(ord) AS first_ord, least(count(*), 10) AS copies,
  grp || ';' || number || ';' || array_to_string(list_slice(list(source_ref ORDER BY ord, source_ref), 1, 10), ',') AS evidence FROM copied GROUP BY grp, number, party HAVING count(*) > 1
 UNION ALL SELECT 26, key, '', min(ord), least(count(*), 10), grp || ';' || CAST(invoice_date AS VARCHAR) || ';' || CAST(doc_value AS VARCHAR) || ';'
  || array_to_string(list_slice(list(source_ref ORDER BY ord, source_ref), 1, 10), ',') FROM alike GROUP BY key, grp, invoice_date, doc_value)
SELECT finding_id, key, array_to_string(list_slice(flatten(list(list_transform(range(copies), lambda i: evidence) ORDER BY first_ord, within)), 1, 10), ' / ') AS samples
FROM g GROUP BY finding_id, key""").replace("\n\n, g", ", g"))
def val_30_samples(spark, sf):
    """First evidence of both duplicate families."""
    return V.duplicate_samples(copied_feats(spark, sf)).select("finding_id", "key", F.array_join("samples", " / ").alias("samples"))


@query("val_26", with_("features", """
SELECT 'ITC_NOT_RECONCILED_EXTERNALLY' AS code, 'INFO' AS severity WHERE EXISTS
 (SELECT 1 FROM features WHERE category IN ('Purchase', 'Import', 'Expense') AND tax > 0)"""))
def val_26(spark, sf):
    return V.books_findings(feats(spark, sf), RULES).join(F.broadcast(V.catalogue(spark, RULES)), "finding_id") \
        .select("code", "severity")


@query("val_27", with_("ledgers", f"""
SELECT 'LEDGER_BALANCE_UNRECONCILED' AS code, ledger AS key, {money('closing')} || ' vs ' || {money('expected')} AS detail
FROM ledgers WHERE NOT reconciles"""))
def val_27(spark, sf):
    f = feats(spark, sf)
    return V.books_findings(f, RULES, ledgers=A.ledger_balances(f)).filter("finding_id = 28").select(
        F.lit("LEDGER_BALANCE_UNRECONCILED").alias("code"), "key", "detail")


@query("val_28", with_("features", """
SELECT source_ref, 'LLM_CLASSIFICATION_CONCERN' AS code FROM features
WHERE source_ref IN (SELECT 'orders!R' || CAST(2 * o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')"""))
def val_28(spark, sf):
    return V.reviewer_concerns(_concerns(spark, sf), feats(spark, sf)).select("source_ref", F.lit("LLM_CLASSIFICATION_CONCERN").alias("code"))


def _concerns(spark, sf):
    """Reviewers' doubts, each row named twice."""
    return T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("orders!R"), (F.col("o_orderkey") * 2).cast("string")).alias("source_row"),
        F.explode(F.array(F.lit("category may not fit"), F.lit("narration disagrees"))).alias("concern"))


@query("val_28_status", with_("features", """
SELECT 'LLM_CLASSIFICATION_CONCERN' AS code, 'MEDIUM' AS severity, count(*) AS affected_rows, 'ANALYSIS_COMPLETE' AS status_before, 'REVIEW_REQUIRED' AS status_after
FROM features WHERE source_ref IN (SELECT 'orders!R' || CAST(2 * o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT') HAVING count(*) > 0"""))
def val_28_status(spark, sf):
    """Reviewer concerns as a discrepancy group, and how they alone lower the verdict of books without any other finding."""
    f = feats(spark, sf)
    none = V.findings(f, RULES).select("ord", "source_ref", "finding_id", "key").limit(0)
    groups = V.discrepancies(V.with_concerns(none, _concerns(spark, sf), f), rules=RULES)
    settled = _calcs(spark, sf).withColumn("status", F.lit("COMPLETE"))
    before = FI.verdict(f, V.discrepancies(none, rules=RULES), settled).select(F.col("report_status").alias("status_before"))
    after = FI.verdict(f, groups, settled).select(F.col("report_status").alias("status_after"))
    return groups.select("code", "severity", "affected_rows").join(F.broadcast(before)).join(F.broadcast(after))      # one row each


_NEED_SQL = {5: "invoice_number", 6: "invoice_date", 7: "supplier_gstin", 11: "taxable_value/supply", 19: "gst_rate",
             20: "gst_rate", 21: "taxable_value/arithmetic", 23: "original_invoice_ref"}
cte("needs", ("features",), " UNION ALL ".join(
    f"SELECT ord, source_ref, '{n.split('/')[0]}' AS field, {lit(V.NEEDS[n])} AS required_for FROM features WHERE {SQL_CHECKS[i]}"
    for i, n in _NEED_SQL.items()))


@query("val_29", with_("needs", """
SELECT field, required_for, count(*) AS rows_missing,
 array_to_string(list_slice(list(source_ref ORDER BY ord, source_ref), 1, 50), ',') AS source_rows FROM needs GROUP BY 1, 2"""))
def val_29(spark, sf):
    return V.missing_fields(feats(spark, sf), RULES).select(
        "field", "required_for", "rows_missing", F.array_join("source_refs", ",").alias("source_rows"))


cte("disc", ("found",), """
SELECT code, key, any_value(severity) AS severity, any_value(status) AS status, count(DISTINCT source_ref) AS affected_rows,
 min(ord) AS first_ord, arg_min(variant, ord) AS first_variant,
 array_to_string(list_slice(list(source_ref ORDER BY ord, source_ref), 1, 50), ',') AS source_rows
FROM found GROUP BY code, key""")
_RANK_SQL = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"
_MESSAGES = "CASE first_variant " + " ".join(
    f"WHEN {i} THEN {lit(f.message.replace('{base}', 'INR'))}" for i, f in V.CATALOGUE.items()) + " END"


@query("val_30", with_("disc", f"SELECT code, key, severity, status, {_MESSAGES} AS message, affected_rows, first_ord, source_rows FROM disc"))
def val_30(spark, sf):
    found = V.findings(feats(spark, sf), RULES)
    groups = V.discrepancies(found, rules=RULES)
    refs = V.discrepancy_refs(found, rules=RULES)
    return groups.join(refs, ["code", "key"]).select(
        "code", "key", "severity", "status", "message", "affected_rows", "first_ord",
        F.array_join("source_refs", ",").alias("source_rows"))


@query("top_04", with_("disc", f"""
SELECT code, key, severity, row_number() OVER (ORDER BY {_RANK_SQL}, code, first_ord, key) AS place FROM disc"""))
def top_04(spark, sf):
    """Severity-then-code order over ranges of the whole list."""
    groups = V.discrepancies(V.findings(feats(spark, sf), RULES), rules=RULES).select("code", "key", "severity", "severity_rank", "first_ord")
    return overall_rank(groups, [("severity_rank", True), ("code", True), ("first_ord", True)], "key", "place").select("code", "key", "severity", "place")


_RF_ENTRY = f"CAST({_RANK_SQL} AS VARCHAR) || ':' || code || ':' || severity || ':' || status"


@query("val_31", with_("found", f"""
SELECT source_ref, count(*) AS n_findings, array_to_string(list(entry ORDER BY entry), ',') AS findings
FROM (SELECT source_ref, {_RF_ENTRY} AS entry FROM found) GROUP BY 1"""))
def val_31(spark, sf):
    out = V.row_findings(V.findings(feats(spark, sf), RULES), RULES)
    text = F.transform("findings", lambda x: F.concat_ws(":", x["severity_rank"].cast("string"), x["code"], x["severity"], x["status"]))
    return out.select("source_ref", F.size("findings").cast("bigint").alias("n_findings"), F.array_join(text, ",").alias("findings"))


def analysed(spark, sf):
    """Features, all discrepancy groups and figures of the sample books."""
    f = feats(spark, sf)
    whole = V.books_findings(f, RULES, T.business_gstin(), A.ledger_balances(f))
    return f, V.discrepancies(V.findings(f, RULES), whole, RULES), A.calculations(f, RULES)


_WHOLE = """
 SELECT severity, status, code FROM disc
 UNION ALL SELECT 'MEDIUM', 'POSSIBLE', 'LEDGER_BALANCE_UNRECONCILED' FROM ledgers WHERE NOT reconciles
 UNION ALL SELECT 'INFO', 'CONFIRMED', 'ITC_NOT_RECONCILED_EXTERNALLY' WHERE EXISTS
  (SELECT 1 FROM features WHERE category IN ('Purchase', 'Import', 'Expense') AND tax > 0)"""
cte("all_disc", ("disc", "ledgers", "features"), _WHOLE)
cte("verdict_in", ("all_disc", "calcs", "features"), """
SELECT (SELECT count(*) FROM features WHERE in_base_currency AND grp IN ('outward', 'inward', 'credit_notes', 'debit_notes', 'expenses')
  AND (taxable IS NOT NULL OR tax IS NOT NULL)) AS usable_rows,
 (SELECT count_if(severity IN ('HIGH', 'MEDIUM')) FROM all_disc) AS blocking,
 (SELECT count_if(status IN ('INCOMPLETE', 'UNRESOLVED')) FROM calcs WHERE section = 'gst') AS open_n,
 (SELECT coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') FROM all_disc WHERE severity = 'HIGH' AND status = 'CONFIRMED') AS high""")
_STATUS_SQL = ("CASE WHEN usable_rows = 0 THEN 'INSUFFICIENT_DATA' WHEN blocking > 0 OR open_n > 0 THEN 'REVIEW_REQUIRED' "
               "ELSE 'ANALYSIS_COMPLETE' END")


@query("val_32", with_("verdict_in", f"SELECT {_STATUS_SQL} AS report_status, usable_rows, blocking, open_n FROM verdict_in"))
def val_32(spark, sf):
    return FI.verdict(*analysed(spark, sf)).select(
        "report_status", "usable_rows", "blocking", F.size("open_calculations").cast("bigint").alias("open_n"))


READINESS_SQL = (f"CASE WHEN usable_rows = 0 OR high <> '' THEN 'NOT_READY' WHEN {_STATUS_SQL} = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' "
                 "ELSE 'PREPARED_FOR_PROFESSIONAL_REVIEW' END")


@query("val_33", with_("verdict_in", f"SELECT {READINESS_SQL} AS readiness, high AS confirmed_high FROM verdict_in"))
def val_33(spark, sf):
    return FI.verdict(*analysed(spark, sf)).select("readiness", F.array_join("confirmed_high", ",").alias("confirmed_high"))


cte("per_row", ("found",), f"""
SELECT source_ref, array_to_string(list(DISTINCT code ORDER BY code), ',') AS codes, min({_RANK_SQL}) AS worst FROM found GROUP BY 1""")


@query("val_34", with_("features per_row", f"""
SELECT source_ref, category, grp, invoice_number, party_name AS party,
 CASE WHEN grp IN ('inward', 'debit_notes', 'expenses') THEN supplier_gstin ELSE recipient_gstin END AS counterparty_gstin,
 CAST(taxable AS VARCHAR) AS taxable_value, {money('tax')} AS tax, coalesce(codes, '') AS codes
FROM features LEFT JOIN per_row USING (source_ref)"""))
def val_34(spark, sf):
    f = feats(spark, sf)
    out = V.row_summary(f, V.findings(f, RULES), RULES)
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["code"]))), ",")
    return out.select("source_ref", "category", F.col("group").alias("grp"), "invoice_number", "party", "counterparty_gstin",
                      "taxable_value", A.cents(F.col("tax").cast("decimal(28,4)")).cast("string").alias("tax"), codes.alias("codes"))


@query("val_35", with_("features per_row", """
SELECT source_ref, CASE WHEN worst = 0 THEN 'issues' WHEN worst < 3 THEN 'review' ELSE 'none' END AS row_status
FROM features LEFT JOIN per_row USING (source_ref)"""))
def val_35(spark, sf):
    f = feats(spark, sf)
    return V.row_summary(f, V.findings(f, RULES), RULES).select("source_ref", V.row_status(F.col("findings")).alias("row_status"))


_ACTIONS = "CASE code " + " ".join(
    f"WHEN '{f.code}' THEN {lit(f.action)}" for i, f in V.CATALOGUE.items() if i != 16) + " END"


@query("val_36", with_("disc", f"""
SELECT recommended_action, count(*) AS n_groups, min({_RANK_SQL}) AS first_rank FROM (SELECT *, {_ACTIONS} AS recommended_action FROM disc
WHERE severity IN ('HIGH', 'MEDIUM')) GROUP BY 1"""))
def val_36(spark, sf):
    groups = V.discrepancies(V.findings(feats(spark, sf), RULES), rules=RULES)
    counts = groups.filter(F.col("severity").isin("HIGH", "MEDIUM")).groupBy("recommended_action").agg(
        F.count(F.lit(1)).alias("n_groups"))
    return V.recommended_actions(groups).join(counts, "recommended_action").select(
        "recommended_action", "n_groups", F.col("first_seen.severity_rank").alias("first_rank"))


# ---------------------------------------------------------------- joins by reference
@query("jon_01", with_("books", """
SELECT b.source_ref, p.category, coalesce(p.ambiguous, false) AS ambiguous FROM books b
LEFT JOIN (SELECT source_ref, category, ambiguous FROM books WHERE ord % 9 <> 0) p USING (source_ref)"""))
def jon_01(spark, sf):
    tx = T.books(spark, sf)
    cls = tx.filter("ord % 9 <> 0").select("source_ref", "category", "score", "ambiguous")
    return FE.features(tx, RULES, T.business_gstin(), cls).select("source_ref", "category", "ambiguous")


@query("jon_02", with_("features per_row", """
SELECT source_ref, category, grp, coalesce(codes, '') AS codes FROM features LEFT JOIN per_row USING (source_ref)"""))
def jon_02(spark, sf):
    f = feats(spark, sf)
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["code"]))), ",")
    return V.row_summary(f, V.findings(f, RULES), RULES).select("source_ref", "category", F.col("group").alias("grp"), codes.alias("codes"))

"""Queries over raw text: cleaning, parsing, header mapping, text building and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.config import Limits
from voucherflow.functions import parsing as P
from voucherflow.functions import text as X
from voucherflow.operators import normalize as N
from voucherflow.operators.features import once_each
from voucherflow.plans.classification import _fold, trim_sql
from voucherflow.plans.ctes import cte, lit, lits, with_
from voucherflow.plans.registry import query
from voucherflow.sources import readers, sinks
from voucherflow.sources import tables as T
from voucherflow.sources.wide import WIDE_COLUMNS, wide_vouchers

_GROUPED = "format('{{:,.2f}}', CAST({} AS DOUBLE))"


def books_raw(spark, sf, stepwise=False):
    """The books as a messy worksheet: text cells, padded headers, a second alias, a label column."""
    b, k, c = T.books(spark, sf), F.col("ord"), F.col
    grouped = lambda n: F.format_number(c(n), 2)
    cells = [
        F.concat(F.lit(" "), c("invoice_number"), F.lit("  ")).alias(" Invoice  No "),
        F.when(k % 10 == 3, F.concat(F.lit("B-"), k.cast("string"))).when(k % 10 == 4, c("invoice_number")).alias("Bill No"),
        F.when(k % 4 == 0, F.date_format("invoice_date", "dd/MM/yyyy")).when(k % 4 == 1, F.date_format("invoice_date", "d-M-yyyy"))
        .when(k % 97 == 2, "soon").otherwise(c("invoice_date").cast("string")).alias("Invoice Date"),
        F.lower(F.concat(F.substring("party_gstin", 1, 5), F.lit(" "), F.substring("party_gstin", 6, 20))).alias("GSTIN"),
        F.when(k % 31 == 1, "n/a").when(k % 6 == 0, F.concat(F.lit("₹ "), grouped("taxable_value")))
        .when(k % 6 == 1, F.concat(F.lit("Rs. "), c("taxable_value").cast("string")))
        .when(k % 6 == 2, F.concat(F.lit("("), grouped("taxable_value"), F.lit(")"))).when(k % 6 == 3, "-")
        .otherwise(F.concat(F.lit("INR "), c("taxable_value").cast("string"))).alias("Taxable Value"),
        F.when(k % 3 == 0, F.concat(c("gst_rate_text"), F.lit(" %"))).otherwise(c("gst_rate_text")).alias("GST Rate"),
        c("cgst").cast("string").alias("CGST"), grouped("sgst").alias("SGST/UTGST"), c("igst").cast("string").alias("Integrated Tax"),
        F.when(k % 8 == 0, "NaN").otherwise(c("total_tax").cast("string")).alias("Tax Amount"),
        grouped("total_amount").alias("Invoice Value"), F.concat(F.lit(" "), F.lower("currency"), F.lit(" ")).alias("Currency"),
        c("supplier_name").alias("Vendor Name"), c("customer_name").alias("Party"),
        F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit("row\t"), k.cast("string"), F.lit("\x01"))).alias("Remarks"),
        c("category").alias("Voucher Category"), F.lit(None).cast("string").alias("Spare")]
    if not stepwise:
        return b.select("ord", "source_ref", *cells)
    # All cells are wanted: a few at a time, as one method for all would be too large for the JVM to compile.
    names = b.select(*cells).columns
    made = once_each(b, {f"__b{i}": x for i, x in enumerate(cells)}, 3)
    return made.select("ord", "source_ref", *[F.col(f"__b{i}").alias(n) for i, n in enumerate(names)])


cte("raw", ("books",), f"""
SELECT ord, source_ref, ' ' || invoice_number || '  ' AS " Invoice  No ",
 CASE WHEN ord % 10 = 3 THEN 'B-' || CAST(ord AS VARCHAR) WHEN ord % 10 = 4 THEN invoice_number END AS "Bill No",
 CASE WHEN ord % 4 = 0 THEN strftime(invoice_date, '%d/%m/%Y') WHEN ord % 4 = 1 THEN strftime(invoice_date, '%-d-%-m-%Y')
  WHEN ord % 97 = 2 THEN 'soon' ELSE CAST(invoice_date AS VARCHAR) END AS "Invoice Date",
 lower(substr(party_gstin, 1, 5) || ' ' || substr(party_gstin, 6)) AS "GSTIN",
 CASE WHEN ord % 31 = 1 THEN 'n/a' WHEN ord % 6 = 0 THEN '₹ ' || {_GROUPED.format('taxable_value')} WHEN ord % 6 = 1 THEN 'Rs. ' || CAST(taxable_value AS VARCHAR)
  WHEN ord % 6 = 2 THEN '(' || {_GROUPED.format('taxable_value')} || ')' WHEN ord % 6 = 3 THEN '-' ELSE 'INR ' || CAST(taxable_value AS VARCHAR) END AS "Taxable Value",
 CASE WHEN ord % 3 = 0 THEN gst_rate_text || ' %' ELSE gst_rate_text END AS "GST Rate",
 CAST(cgst AS VARCHAR) AS "CGST", {_GROUPED.format('sgst')} AS "SGST/UTGST", CAST(igst AS VARCHAR) AS "Integrated Tax",
 CASE WHEN ord % 8 = 0 THEN 'NaN' ELSE CAST(total_tax AS VARCHAR) END AS "Tax Amount",
 {_GROUPED.format('total_amount')} AS "Invoice Value", ' ' || lower(currency) || ' ' AS "Currency",
 supplier_name AS "Vendor Name", customer_name AS "Party",
 CASE WHEN ord % 5 = 0 THEN 'null' ELSE 'row' || chr(9) || CAST(ord AS VARCHAR) || chr(1) END AS "Remarks",
 category AS "Voucher Category", CAST(NULL AS VARCHAR) AS "Spare" FROM books""")

RAW_COLUMNS = (" Invoice  No ", "Bill No", "Invoice Date", "GSTIN", "Taxable Value", "GST Rate", "CGST", "SGST/UTGST", "Integrated Tax",
               "Tax Amount", "Invoice Value", "Currency", "Vendor Name", "Party", "Remarks", "Voucher Category", "Spare")


def cell_sql(x: str) -> str:
    t = trim_sql(f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")
    return f"CASE WHEN {t} <> '' AND lower({t}) NOT IN ('nan', 'none', 'nat', 'null') THEN {t} END"


def money_text_sql(x: str) -> str:
    bare = f"regexp_replace(trim({x}), '(?i)inr|rs\\.?|₹|,|\\s|\\(|\\)', '', 'g')"
    return (f"CASE WHEN {bare} NOT IN ('', '-') THEN CASE WHEN starts_with(trim({x}), '(') AND suffix(trim({x}), ')') "
            f"THEN '-' || {bare} ELSE {bare} END END")


def date_sql(x: str) -> str:
    return f"coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%d/%m/%Y'), try_strptime({x}, '%d-%m-%Y'))"


cte("cells", ("raw",), "SELECT ord, source_ref, " + ", ".join(f'{cell_sql(chr(34) + c + chr(34))} AS "{c}"' for c in RAW_COLUMNS) + " FROM raw")

_HEADERS = (" Invoice   No", "BILL NO ", "Unit Rate", "GSTIN/UIN", "Sgst/Utgst", "taxable\tvalue", "Grand Total", "Notes", "Ledger  Name",
            "GST %", "customer gstin", "Place Of Supply", "HSN Code", "DR Amount", "Against Invoice", "Party", "Net Amount")


def header_values(spark, sf):
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"),
                                               T.pick(F.col("o_orderkey") % len(_HEADERS), _HEADERS).alias("header"))


_ALIAS_CASE = "CASE folded " + " ".join(f"WHEN {lit(a)} THEN '{f}'" for a, f in schema.alias_lookup().items()) + " END"


@query("nrm_01", f"""
SELECT ord, folded, {_ALIAS_CASE} AS canonical FROM (SELECT o_orderkey AS ord, {_fold(f"([{lits(_HEADERS)}])[o_orderkey % {len(_HEADERS)} + 1]")} AS folded FROM orders)""")
def nrm_01(spark, sf):
    return header_values(spark, sf).select("ord", P.fold_header(F.col("header")).alias("folded"), N.canonical_header(F.col("header")).alias("canonical"))


_INV1, _INV2 = 'trim(" Invoice  No ")', 'trim("Bill No")'
_MONEY_COLS = {"taxable_value": "Taxable Value", "cgst": "CGST", "sgst": "SGST/UTGST", "igst": "Integrated Tax", "total_tax": "Tax Amount",
               "total_amount": "Invoice Value"}
_BAD = " + ".join(
    [f'CASE WHEN ({money_text_sql(chr(34) + c + chr(34))}) IS NOT NULL AND try_cast(({money_text_sql(chr(34) + c + chr(34))}) AS DECIMAL(28,10)) IS NULL THEN 1 ELSE 0 END'
     for c in _MONEY_COLS.values()]
    + [f'CASE WHEN "Invoice Date" IS NOT NULL AND {date_sql(chr(34) + "Invoice Date" + chr(34))} IS NULL THEN 1 ELSE 0 END',
       f"CASE WHEN {_INV1} <> {_INV2} THEN 1 ELSE 0 END"])
_RATE_TEXT = "regexp_replace(trim(\"GST Rate\"), '%+\\s*$', '')"
cte("extracted", ("cells",), f"""
SELECT ord, source_ref, coalesce({_INV1}, {_INV2}) AS invoice_number, CAST({date_sql('"Invoice Date"')} AS DATE) AS invoice_date,
 upper(regexp_replace("GSTIN", '\\s', '', 'g')) AS party_gstin, """ + ", ".join(
    f'try_cast(({money_text_sql(chr(34) + c + chr(34))}) AS DECIMAL(28,10)) AS {n}' for n, c in _MONEY_COLS.items()) + f""",
 {money_text_sql(_RATE_TEXT)} AS gst_rate_text, upper(trim("Currency")) AS currency, trim("Vendor Name") AS supplier_name,
 trim("Party") AS customer_name, {_BAD} AS n_warnings FROM cells""")
_EXTRACTED = ("source_ref", "invoice_number", "party_gstin", "gst_rate_text", "currency", "supplier_name", "customer_name")


def _two(n):
    return F.col(n).cast("decimal(28,2)").cast("string").alias(n)


@query("nrm_02", with_("extracted", "SELECT " + ", ".join(_EXTRACTED) + ", CAST(invoice_date AS VARCHAR) AS invoice_date, " + ", ".join(
    f"CAST(CAST({n} AS DECIMAL(28,2)) AS VARCHAR) AS {n}" for n in _MONEY_COLS) + ", CAST(n_warnings AS BIGINT) AS n_warnings FROM extracted"))
def nrm_02(spark, sf):
    out = N.normalize(books_raw(spark, sf, stepwise=True))
    return out.select(*_EXTRACTED, F.col("invoice_date").cast("string").alias("invoice_date"), *[_two(n) for n in _MONEY_COLS],
                      F.size("parse_warnings").cast("bigint").alias("n_warnings"))


@query("nrm_03", f"SELECT doc_id, md5({cell_sql('text')}) AS cleaned FROM documents")
def nrm_03(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.md5(P.clean_cell(F.col("text"), None)).alias("cleaned"))


@query("nrm_04", with_("cells", f"""
SELECT source_ref, CAST(CAST(try_cast(({money_text_sql('"Taxable Value"')}) AS DECIMAL(28,10)) AS DECIMAL(28,2)) AS VARCHAR) AS taxable_value FROM cells"""))
def nrm_04(spark, sf):
    cells = N.clean_cells(books_raw(spark, sf))
    return cells.select("source_ref", P.parse_money(F.col("Taxable Value")).cast("decimal(28,2)").cast("string").alias("taxable_value"))


@query("nrm_05", with_("cells", f"""
SELECT source_ref, {money_text_sql(_RATE_TEXT)} AS rate_text, CAST(try_cast(({money_text_sql(_RATE_TEXT)}) AS DECIMAL(9,4)) AS VARCHAR) AS rate FROM cells"""))
def nrm_05(spark, sf):
    cells, r = N.clean_cells(books_raw(spark, sf)), F.col("GST Rate")
    return cells.select("source_ref", P.rate_text(r).alias("rate_text"), P.parse_rate(r).cast("string").alias("rate"))


@query("nrm_06", with_("cells", f"""SELECT source_ref, CAST(CAST({date_sql('"Invoice Date"')} AS DATE) AS VARCHAR) AS invoice_date FROM cells"""))
def nrm_06(spark, sf):
    cells = N.clean_cells(books_raw(spark, sf))
    return cells.select("source_ref", P.parse_date(F.col("Invoice Date")).cast("string").alias("invoice_date"))


@query("nrm_07", with_("raw", """
SELECT source_ref, upper(regexp_replace("GSTIN", '\\s', '', 'g')) AS gstin, upper(trim("Currency")) AS currency, trim(" Invoice  No ") AS invoice_number FROM raw"""))
def nrm_07(spark, sf):
    return books_raw(spark, sf).select("source_ref", P.parse_code(F.col("GSTIN")).alias("gstin"),
                                       F.upper(P.trim_all(F.col("Currency"))).alias("currency"),
                                       P.trim_all(F.col("` Invoice  No `")).alias("invoice_number"))


@query("nrm_08", with_("raw", "SELECT column_name, count(*) AS n_rows FROM (SELECT 'Voucher Category' AS column_name FROM raw WHERE \"Voucher Category\" IS NOT NULL) GROUP BY 1"))
def nrm_08(spark, sf):
    raw = books_raw(spark, sf)
    dropped = N.dropped_columns(raw.columns)
    filled = raw.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in dropped])
    return filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_rows")) for c in dropped])).alias("e")).select("e.*")


@query("nrm_09", with_("cells", "SELECT column_name, filled FROM (" + " UNION ALL ".join(
    f'SELECT {lit(c)} AS column_name, count("{c}") AS filled FROM cells' for c in RAW_COLUMNS) + ") WHERE filled = 0"))
def nrm_09(spark, sf):
    return N.empty_columns(N.clean_cells(N.drop_empty_rows(books_raw(spark, sf))))


@query("nrm_10", with_("raw", """
SELECT 'rows' AS limit_name, count(*) AS observed, 5000 AS allowed, count(*) <= 5000 AS within FROM raw
UNION ALL SELECT 'columns', 19, 300, true UNION ALL SELECT 'sheets', (SELECT count(DISTINCT "Currency") FROM raw), 20, true"""))
def nrm_10(spark, sf):
    return N.limit_report(books_raw(spark, sf), Limits(max_rows=5000, max_columns=300, max_sheets=20), "Currency")


@query("nrm_11", with_("extracted", "SELECT CAST(sum(n_warnings) AS BIGINT) AS warnings, count_if(n_warnings > 0) AS rows_with_warnings FROM extracted"))
def nrm_11(spark, sf):
    return N.warning_totals(N.normalize(books_raw(spark, sf, stepwise=True)))


_TRAIN_FIELDS = [f for f in schema.WIDE_SOURCES if any(n in WIDE_COLUMNS for n in schema.wide_sources(f))]


@query("nrm_12", with_("wide", "SELECT source_ref, " + ", ".join(
    f"coalesce({', '.join(chr(34) + n + chr(34) for n in schema.wide_sources(f) if n in WIDE_COLUMNS)}, NULL) AS {f}" for f in _TRAIN_FIELDS) + " FROM wide"))
def nrm_12(spark, sf):
    return N.wide_to_canonical(wide_vouchers(spark, sf)).drop("ord")


@query("nrm_13", "SELECT o_orderkey AS invoice_number, o_orderstatus AS payment_status, o_orderpriority AS transaction_narration, o_custkey AS buyer_customer FROM orders")
def nrm_13(spark, sf):
    o = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Invoice-No "), F.col("o_orderstatus").alias("Payment Status"),
        F.col("o_orderpriority").alias("NARRATION"), F.col("o_custkey").alias("Customer"))
    return N.canonical_columns(o)


@query("nrm_14", """
SELECT event_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) END AS whole, CASE WHEN v IS NULL THEN 'none' ELSE 'some' END AS filled
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN floor(value) WHEN event_id % 3 = 1 THEN NULL ELSE value END AS v FROM events)""")
def nrm_14(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double"))
                                            .when(F.col("event_id") % 3 == 2, F.col("value")).alias("v"))
    text = X.format_value(F.col("v"), "double")
    return e.select("event_id", F.when(F.col("v") == F.floor("v"), text).alias("whole"),
                    F.when(text.isNull(), "none").otherwise("some").alias("filled"))


def _serialise_sql(columns) -> str:
    def one(n):
        t = trim_sql(f'"{n}"')
        return f"CASE WHEN {t} <> '' AND lower({t}) NOT IN ('nan', 'none', 'nat') THEN {lit(n + ': ')} || {t} END"
    return "concat_ws(' | ', " + ", ".join(one(n) for n in columns) + ")"


def serialise(df):
    kinds = dict(df.dtypes)
    skip = {schema.LABEL_COLUMN, *N.PROVENANCE}
    return X.labelled_text([(c, X.format_value(F.col(f"`{c}`"), kinds[c])) for c in df.columns if c not in skip])


cte("serialised", ("wide",), f"SELECT source_ref, {_serialise_sql(WIDE_COLUMNS)} AS serialised FROM wide")


@query("nrm_15", with_("serialised", "SELECT source_ref, serialised FROM serialised"))
def nrm_15(spark, sf):
    df = wide_vouchers(spark, sf)
    return df.select("source_ref", serialise(df).alias("serialised"))


def training_rows(spark, sf):
    """Canonical training rows: text from documents and parts, figures from orders."""
    o = T.spread(T.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"),
                                            F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("amt"),
                                            F.col("o_orderdate").cast("date").alias("d"))
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), "p_name")
    parts = max(1, p.count())       # part keys run from zero, so every part is met
    k = F.col("k")
    q = (k % 9 + 1).cast("double")
    price = (k % 40).cast("double") + 0.5
    value = F.when(k % 6 == 0, q * price).otherwise(F.col("amt"))
    rate = T.pick(k % 6, T.RATE_BY_SLOT).cast("double")
    core = T.pick(k % 20, tuple(f"Goods recorded for case {i} by the {c.lower()} desk." for i, c in enumerate(T.CATEGORY_BY_SLOT)))
    return o.join(p, F.col("pk") == k % parts, "left").select(
        k.alias("ord"), T.category_at(k).alias("label"), (k % 25).alias("split_group"),
        F.when(k % 5 != 0, F.concat(F.lit("Party "), F.col("cust").cast("string"))).alias("seller_supplier"),
        F.when(k % 5 == 0, F.concat(F.lit("Party "), F.col("cust").cast("string"))).alias("buyer_customer"),
        F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_number"), F.col("d").alias("transaction_date"),
        F.col("p_name").alias("item_description"),
        F.concat(core, F.lit(" Shift "), (k % 3).cast("string"), F.when(k % 4 == 0, " noted. Ref").otherwise(". Ref"),
                 F.when(k % 7 != 0, F.concat(F.lit(" TXN-"), k.cast("string"), F.lit(" dated."))).otherwise(F.lit(" none."))).alias("transaction_narration"),
        F.when(k % 8 != 0, q).alias("quantity"), price.alias("unit_price"), value.alias("taxable_value"),
        rate.alias("gst_rate_percent"), F.when(k % 10 != 0, F.floor(value * rate) / 100).alias("gst_amount"),
        F.when(k % 4 != 0, "INR").alias("currency"), T.pick(k % 3, ("NEFT", "Cash", "Card  Swipe")).alias("payment_method"),
        T.pick(k % 20, tuple(f"Status {i % 7}" for i in range(20))).alias("payment_status"),
        F.when((k % 20).isin(14, 15), "Damaged Goods").alias("return_reason"),
        F.when(k % 3 == 0, "Cash / Bank").alias("debit_credit_info"),
        F.when(k % 20 == 19, F.col("amt")).alias("gross_pay_amount"), F.when(k % 20 == 19, F.lit(100.0)).alias("deductions_amount"),
        F.when(k % 20 == 19, F.when(k % 40 == 19, F.col("amt") - 100.0).otherwise(F.col("amt"))).alias("net_pay_amount"))


_CORES = ", ".join(lit(f"Goods recorded for case {i} by the {c.lower()} desk.") for i, c in enumerate(T.CATEGORY_BY_SLOT))
_CATS = lits(T.CATEGORY_BY_SLOT)
cte("training", (), f"""
SELECT k AS ord, ([{_CATS}])[k % 20 + 1] AS label, k % 25 AS split_group,
 CASE WHEN k % 5 <> 0 THEN 'Party ' || CAST(cust AS VARCHAR) END AS seller_supplier,
 CASE WHEN k % 5 = 0 THEN 'Party ' || CAST(cust AS VARCHAR) END AS buyer_customer, 'INV-' || CAST(k AS VARCHAR) AS invoice_number,
 d AS transaction_date, p_name AS item_description,
 ([{_CORES}])[k % 20 + 1] || ' Shift ' || CAST(k % 3 AS VARCHAR) || CASE WHEN k % 4 = 0 THEN ' noted. Ref' ELSE '. Ref' END
  || CASE WHEN k % 7 <> 0 THEN ' TXN-' || CAST(k AS VARCHAR) || ' dated.' ELSE ' none.' END AS transaction_narration,
 CASE WHEN k % 8 <> 0 THEN q END AS quantity, price AS unit_price, value AS taxable_value, rate AS gst_rate_percent,
 CASE WHEN k % 10 <> 0 THEN floor(value * rate) / 100 END AS gst_amount, CASE WHEN k % 4 <> 0 THEN 'INR' END AS currency,
 (['NEFT', 'Cash', 'Card  Swipe'])[k % 3 + 1] AS payment_method, 'Status ' || CAST((k % 20) % 7 AS VARCHAR) AS payment_status,
 CASE WHEN k % 20 IN (14, 15) THEN 'Damaged Goods' END AS return_reason, CASE WHEN k % 3 = 0 THEN 'Cash / Bank' END AS debit_credit_info,
 CASE WHEN k % 20 = 19 THEN amt END AS gross_pay_amount, CASE WHEN k % 20 = 19 THEN 100.0::DOUBLE END AS deductions_amount,
 CASE WHEN k % 20 = 19 THEN CASE WHEN k % 40 = 19 THEN amt - 100.0::DOUBLE ELSE amt END END AS net_pay_amount
FROM (SELECT *, CASE WHEN k % 6 = 0 THEN q * price ELSE amt END AS value, CAST(([0, 5, 12, 18, 28, 17])[k % 6 + 1] AS DOUBLE) AS rate FROM (
 SELECT o_orderkey AS k, o_custkey AS cust, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amt, CAST(o_orderdate AS DATE) AS d,
  CAST(o_orderkey % 9 + 1 AS DOUBLE) AS q, CAST(o_orderkey % 40 AS DOUBLE) + 0.5 AS price FROM orders))
 LEFT JOIN part ON p_partkey = k % (SELECT count(*) FROM part)""")
_TEXT_COLS = ("seller_supplier", "buyer_customer", "invoice_number", "transaction_date", "item_description", "transaction_narration",
              "currency", "payment_method", "payment_status", "return_reason", "debit_credit_info")


def make_text(df, fields=schema.TRAINING_FIELDS):
    """Field-labelled text of the training row; dates as ISO, empty fields left out."""
    kinds = dict(df.dtypes)

    def cell(n):
        c = F.col(n).cast("string") if kinds[n] != "timestamp" else F.date_format(n, "yyyy-MM-dd")
        return F.when(P.trim_all(c) != "", P.trim_all(c))
    return X.labelled_text([(n.replace("_", " "), cell(n)) for n in fields if n in df.columns])


cte("train_text", ("training",), "SELECT ord, concat_ws(' | ', " + ", ".join(
    f"CASE WHEN trim(CAST({n} AS VARCHAR)) <> '' THEN '{n.replace('_', ' ')}: ' || trim(CAST({n} AS VARCHAR)) END" for n in _TEXT_COLS)
    + ") AS text_input FROM training")


@query("nrm_16", with_("train_text", "SELECT ord, text_input FROM train_text"))
def nrm_16(spark, sf):
    df = training_rows(spark, sf)
    return df.select("ord", make_text(df, _TEXT_COLS).alias("text_input"))


_SENT = ("CASE WHEN regexp_matches(transaction_narration, 'TXN-\\d+') THEN regexp_extract(regexp_extract(transaction_narration, "
         "'(?s)^(.*?)TXN-\\d+', 1), '(?s)^(.*\\.)', 1) ELSE transaction_narration END")
_CORE = _fold(f"regexp_replace({_SENT}, '\\d+', '#', 'g')")


@query("nrm_17", with_("training", f"SELECT ord, {_CORE} AS core, {trim_sql(_SENT)} AS verbatim FROM training"))
def nrm_17(spark, sf):
    n = F.col("transaction_narration")
    return training_rows(spark, sf).select("ord", X.narration_core(n).alias("core"), X.narration_verbatim(n).alias("verbatim"))


def mask_sql(x):
    inner = f"regexp_replace(coalesce({x}, ''), {lit(X.ID_TOKEN)}, ' idtoken ', 'g')"
    return _fold(f"regexp_replace({inner}, '\\d+', '#', 'g')")


@query("nrm_18", with_("training", f"SELECT ord, {mask_sql('transaction_narration')} AS narration, {mask_sql('invoice_number')} AS invoice FROM training"))
def nrm_18(spark, sf):
    return training_rows(spark, sf).select("ord", X.mask_text(F.col("transaction_narration")).alias("narration"),
                                           X.mask_text(F.col("invoice_number")).alias("invoice"))


_ID_COLS = [c for c in schema.OWN_ID_COLUMNS if c in WIDE_COLUMNS]
_INV_PICK = [n for n in schema.PICK_INVOICE if n in WIDE_COLUMNS]
_PARTY_PICK = [n for n in schema.PICK_PARTY if n in WIDE_COLUMNS]
_AMT_PICK = [n for n in schema.PICK_AMOUNT if n in WIDE_COLUMNS]


def _pick_sql(names):
    return "coalesce(" + ", ".join(f'CASE WHEN {trim_sql(chr(34) + n + chr(34))} <> \'\' THEN "{n}" END' for n in names) + ")"


@query("nrm_19", with_("wide", f"SELECT source_ref, {_pick_sql(_INV_PICK)} AS invoice, {_pick_sql(_PARTY_PICK)} AS party, {_pick_sql(_AMT_PICK)} AS amount FROM wide"))
def nrm_19(spark, sf):
    df = wide_vouchers(spark, sf).drop("Voucher Category")
    rows = df.select("source_ref", N.raw_map(df).alias("record"))
    return rows.select("source_ref", N.pick_field(F.col("record"), schema.PICK_INVOICE).alias("invoice"),
                       N.pick_field(F.col("record"), schema.PICK_PARTY).alias("party"), N.pick_field(F.col("record"), schema.PICK_AMOUNT).alias("amount"))


_DEFAULT_GSTIN = "27ABCDE1234F1Z5"   # fixed value shown for rows without a GSTIN


def console_mapping(df):
    """Upload-screen row: defaults for missing fields, bare amount, split into taxable and tax."""
    c = F.col
    filled = lambda x: F.when(P.trim_all(x) != "", P.trim_all(x))
    bare = F.regexp_replace(c("amount_text"), r"[^0-9.-]+", "").try_cast("double")
    df = df.withColumn("raw_amount", F.coalesce(F.nullif(bare, F.lit(0.0)), F.lit(1000.0)))
    df = df.withColumn("taxable_amount", F.floor(c("raw_amount") * 0.8475 + 0.5).cast("double"))
    return df.select("ord", F.coalesce(filled(c("invoice")), F.concat(F.lit("INV-"), (c("ord") + 1000).cast("string"))).alias("invoice_no"),
                     F.coalesce(filled(c("party")), F.lit("Unspecified Counterparty")).alias("party"), "raw_amount", "taxable_amount",
                     F.round(c("raw_amount") - c("taxable_amount"), 2).alias("tax_amount"),
                     F.coalesce(filled(c("gstin")), F.lit(_DEFAULT_GSTIN)).alias("gstin"))


@query("nrm_20", with_("raw", f"""
SELECT ord, invoice_no, party, raw_amount, floor(raw_amount * 0.8475::DOUBLE + 0.5::DOUBLE) AS taxable_amount,
 round(raw_amount - floor(raw_amount * 0.8475::DOUBLE + 0.5::DOUBLE), 2) AS tax_amount, gstin FROM (
 SELECT ord, coalesce(nullif(trim(" Invoice  No "), ''), 'INV-' || CAST(ord + 1000 AS VARCHAR)) AS invoice_no,
  coalesce(nullif(trim("Party"), ''), 'Unspecified Counterparty') AS party,
  coalesce(nullif(try_cast(regexp_replace("Invoice Value", '[^0-9.-]+', '', 'g') AS DOUBLE), 0), 1000) AS raw_amount,
  coalesce(nullif(trim("GSTIN"), ''), '{_DEFAULT_GSTIN}') AS gstin FROM raw)"""))
def nrm_20(spark, sf):
    return console_mapping(books_raw(spark, sf).select(
        "ord", F.col("` Invoice  No `").alias("invoice"), F.col("Party").alias("party"), F.col("Invoice Value").alias("amount_text"),
        F.col("GSTIN").alias("gstin")))


def parse_predictions(c):
    """'A (0.91) | B (0.05)' -> [(A, 0.91), (B, 0.05)]"""
    return F.transform(F.split(c, r"\|"), lambda x: F.struct(
        F.regexp_extract(x, r"^\s*(.*?)\s*\(([0-9.]+)\)\s*$", 1).alias("label"),
        F.regexp_extract(x, r"^\s*(.*?)\s*\(([0-9.]+)\)\s*$", 2).try_cast("double").alias("score")))


@query("nrm_21", with_("scored_rank", "SELECT ord, rn, label, CAST(CAST(round(score, 3) AS DECIMAL(6,3)) AS DOUBLE) AS score FROM scored_rank"))
def nrm_21(spark, sf):
    from voucherflow.plans.classification import scored_rows, top_scores
    text = F.array_join(F.transform("top_predictions", lambda x: F.concat(
        x["label"], F.lit(" ("), F.round(x["score"], 3).cast("decimal(6,3)").cast("string"), F.lit(")"))), " | ")
    rows = top_scores(scored_rows(spark, sf)).select("ord", text.alias("shown"))
    return rows.select("ord", F.posexplode(parse_predictions(F.col("shown"))).alias("pos", "e")).select(
        "ord", (F.col("pos") + 1).cast("bigint").alias("rn"), "e.label", "e.score")


@query("nrm_22", with_("raw", """
SELECT source_ref, CASE WHEN "GSTIN" IS NOT NULL THEN '[redacted]' END AS "GSTIN", CASE WHEN "Vendor Name" IS NOT NULL THEN '[redacted]' END AS "Vendor Name",
 CASE WHEN "Party" IS NOT NULL THEN '[redacted]' END AS "Party", "Remarks", "Invoice Value" FROM raw"""))
def nrm_22(spark, sf):
    return N.redact(books_raw(spark, sf)).select("source_ref", "GSTIN", "Vendor Name", "Party", "Remarks", "Invoice Value")


def neutral_sql(x):
    d = f"array_to_string(regexp_extract_all({x}, '\\d+'), '-')"
    return f"CASE WHEN {d} = '' THEN 'DOC' ELSE 'DOC-' || {d} END"


def transform_identifiers(df, mode, columns=schema.OWN_ID_COLUMNS + schema.REFERENCE_ID_COLUMNS):
    """Blank identifier values or replace their prefix with a neutral one; other cells are untouched."""
    if mode not in ("removed", "neutralized"):
        raise ValueError(mode)
    new = {}
    for name in columns:
        if name in df.columns:
            cell = F.col(f"`{name}`")
            swap = F.lit(None).cast("string") if mode == "removed" else X.neutral_identifier(cell)
            new[name] = F.when(P.is_filled(cell), swap).otherwise(cell)
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


_ALL_IDS = [c for c in schema.OWN_ID_COLUMNS + schema.REFERENCE_ID_COLUMNS if c in WIDE_COLUMNS]


def _filled_sql(n):
    t = trim_sql(f'"{n}"')
    return f"({t} <> '' AND lower({t}) NOT IN ('nan', 'none', 'nat'))"


@query("nrm_23", with_("wide", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, source_ref, " + ", ".join(
        f'CASE WHEN {_filled_sql(c)} THEN {"NULL" if m == "removed" else neutral_sql(chr(34) + c + chr(34))} ELSE "{c}" END AS "{c}"' for c in _ALL_IDS) + " FROM wide"
    for m in ("removed", "neutralized"))))
def nrm_23(spark, sf):
    df = wide_vouchers(spark, sf)
    parts = [transform_identifiers(df, m).select(F.lit(m).alias("mode"), "source_ref", *[F.col(f"`{c}`") for c in _ALL_IDS]) for m in ("removed", "neutralized")]
    return parts[0].unionByName(parts[1])


def primary_identifier(df):
    """First filled own-number column of a row, with its value."""
    pairs = [F.when(P.is_filled(F.col(f"`{c}`")), F.struct(F.lit(c).alias("id_column"), P.clean_field(F.col(f"`{c}`")).alias("id_value")))
             for c in schema.OWN_ID_COLUMNS if c in df.columns]
    return F.coalesce(*pairs, F.struct(F.lit("").alias("id_column"), F.lit("").alias("id_value")))


@query("nrm_24", with_("wide", "SELECT source_ref, coalesce(" + ", ".join(f"CASE WHEN {_filled_sql(c)} THEN {lit(c)} END" for c in _ID_COLS)
                       + ", '') AS id_column, coalesce(" + ", ".join(f"CASE WHEN {_filled_sql(c)} THEN {trim_sql(chr(34) + c + chr(34))} END" for c in _ID_COLS)
                       + ", '') AS id_value FROM wide"))
def nrm_24(spark, sf):
    df = wide_vouchers(spark, sf)
    return df.select("source_ref", primary_identifier(df).alias("e")).select("source_ref", "e.*")


@query("nrm_25", with_("wide_clean", 'SELECT source_ref, "Document Number" AS document_number, "Payment ID" AS payment_id, "Narration" AS x FROM (SELECT *, \'\' AS "Narration" FROM wide_clean)'))
def nrm_25(spark, sf):
    return wide_vouchers(spark, sf).select("source_ref", P.clean_field(F.col("`Document Number`")).alias("document_number"),
                                           P.clean_field(F.col("`Payment ID`")).alias("payment_id"), F.lit("").alias("x"))


# ---------------------------------------------------------------- sources
@query("src_01", "SELECT 'orders!R' || CAST(row_number() OVER () + 1 AS VARCHAR) AS source_ref, 'orders' AS source_sheet FROM orders "
                 "UNION ALL SELECT 'supplier!R' || CAST(row_number() OVER () + 1 AS VARCHAR), 'supplier' FROM supplier")
def src_01(spark, sf):
    rows = readers.read_sheets(spark, [(f"{sf}/orders.parquet", "parquet"), (f"{sf}/supplier.parquet", "parquet")])
    return rows.select("source_ref", "source_sheet")


_KEYED = "('[{\"k\": ' || CAST({0} AS VARCHAR) || ', \"t\": \"' || {1} || '\"}, {\"k\": -1}]')"


@query("src_02", "SELECT 'records[' || CAST(pos AS VARCHAR) || ']' AS source_ref, event_id, CASE WHEN pos = 0 THEN CAST(event_id AS VARCHAR) ELSE '-1' END AS k, "
                 "CASE WHEN pos = 0 THEN event_type END AS t FROM events, (SELECT unnest([0, 1]) AS pos)")
def src_02(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.to_json(F.array(
        F.create_map(F.lit("k"), F.col("event_id").cast("string"), F.lit("t"), F.col("event_type")),
        F.create_map(F.lit("k"), F.lit("-1")))).alias("payload"))
    return readers.json_records(e, "payload", "event_id").select("source_ref", "event_id", F.col("record")["k"].alias("k"), F.col("record")["t"].alias("t"))


@query("src_03", "SELECT event_id, event_id % 3 = 2 AS error, CASE WHEN event_id % 3 <> 2 THEN event_type END AS t FROM events")
def src_03(spark, sf):
    one = F.create_map(F.lit("t"), F.col("event_type"))
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(one)))
                                            .when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.array(one).alias("records"))))
                                            .otherwise(F.concat(F.lit("not json "), F.col("event_type"))).alias("payload"))
    return readers.json_records(e, "payload", "event_id").select("event_id", "error", F.col("record")["t"].alias("t"))


@query("src_04", with_("wide", 'SELECT source_ref, "Voucher Category" AS label, \'no\' AS label_in_features FROM wide'))
def src_04(spark, sf):
    features, labels = N.split_label(wide_vouchers(spark, sf), "source_ref")
    return labels.select("source_ref", "label", F.lit("yes" if schema.LABEL_COLUMN in features.columns else "no").alias("label_in_features"))


@query("src_06", with_("training", """
SELECT (SELECT count(*) FROM training) AS n_rows, 0 AS only_in_inputs, 0 AS only_in_labelled, 0 AS leaked_columns"""))
def src_06(spark, sf):
    labelled = training_rows(spark, sf)
    inputs = labelled.drop("label", "split_group")
    return training_alignment(inputs, labelled.drop("split_group"))


def training_alignment(inputs, labelled):
    """Cells of the inputs must equal the labelled rows, and no label-bearing column may be among them."""
    same = [c for c in inputs.columns if c in labelled.columns]
    digest = lambda df: df.select("ord", F.xxhash64(*[F.col(c) for c in same if c != "ord"]).alias("h"))
    left, right = digest(inputs).withColumnRenamed("h", "a"), digest(labelled).withColumnRenamed("h", "b")
    leaked = len(set(inputs.columns) & set(schema.FORBIDDEN_INPUTS))
    return left.join(right, "ord", "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull()).alias("only_in_inputs"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b")) & F.col("b").isNotNull()).alias("only_in_labelled"),
        F.lit(leaked).cast("bigint").alias("leaked_columns"))


@query("src_07", with_("books", "SELECT category, category IN ('Sales', 'Export', 'Receipt') AS outward, count(*) AS n_rows FROM books GROUP BY ALL"))
def src_07(spark, sf):
    from dataclasses import replace
    from voucherflow.config import Rules
    from voucherflow.operators.features import group_of
    rules = replace(Rules(), outward=("Sales", "Export", "Receipt"))
    b = T.books(spark, sf).withColumn("outward", group_of(F.col("category"), rules) == "outward")
    return b.groupBy("category", "outward").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src_08", "SELECT o_orderkey AS ord, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50")
def src_08(spark, sf):
    rows = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return readers.preview(rows)


@query("snk_05", with_("scored_rank", """
SELECT ord, max(CASE WHEN rn = 1 THEN label END) AS predicted_voucher_type, max(CASE WHEN rn = 1 THEN round(score, 4) END) AS model_score,
 string_agg(label || ' (' || CAST(CAST(round(score, 3) AS DECIMAL(6,3)) AS VARCHAR) || ')', ' | ' ORDER BY rn) AS top_3 FROM scored_rank GROUP BY ord"""))
def snk_05(spark, sf):
    from voucherflow.plans.classification import scored_rows, top_scores
    text = F.array_join(F.transform("top_predictions", lambda x: F.concat(
        x["label"], F.lit(" ("), F.round(x["score"], 3).cast("decimal(6,3)").cast("string"), F.lit(")"))), " | ")
    return top_scores(scored_rows(spark, sf)).select(
        "ord", F.col("top_predictions")[0]["label"].alias("predicted_voucher_type"),
        F.round(F.col("top_predictions")[0]["score"], 4).alias("model_score"), text.alias("top_3"))


@query("snk_03", with_("books", 'SELECT invoice_number AS "Invoice No", CAST(invoice_date AS VARCHAR) AS "Date", category AS "Predicted Voucher", CAST(taxable_value AS VARCHAR) AS "Taxable Value" FROM books'))
def snk_03(spark, sf):
    b = T.books(spark, sf).select("invoice_number", F.col("invoice_date").cast("string").alias("invoice_date"), "category",
                                  F.col("taxable_value").cast("string").alias("taxable_value"))
    return sinks.export_rows(b)


_ROWHASH = "sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority))"


@query("snk_06", f"""
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS sum_head, CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) AS sum_next
FROM (SELECT {_ROWHASH} AS h FROM orders)""")
def snk_06(spark, sf):
    return sinks.fingerprint(T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))



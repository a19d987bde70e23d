"""DuckDB text of the derived tables, used only to check the Spark results."""

from __future__ import annotations

from voucherflow import schema
from voucherflow.sources.tables import CATEGORY_BY_SLOT, RATE_BY_SLOT, business_gstin

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    CTES[name] = (needs, text)


def with_(names: str | tuple[str, ...], body: str) -> str:
    """Prefix a query with the named tables and everything they need, in dependency order."""
    wanted = names.split() if isinstance(names, str) else list(names)
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in wanted:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def sql_list(values) -> str:
    return "[" + lits(values) + "]"


def category_sql(k: str) -> str:
    return f"({sql_list(CATEGORY_BY_SLOT)})[({k}) % 20 + 1]"


def check_digit_sql(g: str) -> str:
    ch = lit(schema.BASE36)
    p = f"((instr({ch}, substr({g}, i, 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END))"
    total = f"list_sum(list_transform(range(1, 15), lambda i: {p} // 36 + {p} % 36))"
    return f"substr({ch}, CAST((36 - ({total}) % 36) % 36 AS INT) + 1, 1)"


def gstin_status_sql(g: str) -> str:
    return (f"CASE WHEN coalesce({g}, '') = '' THEN 'missing' "
            f"WHEN NOT regexp_matches({g}, {lit(schema.GSTIN_REGEX)}) THEN 'invalid_format' "
            f"WHEN {check_digit_sql(g)} <> substr({g}, 15, 1) THEN 'invalid_checksum' ELSE 'valid' END")


def money(expr: str) -> str:
    """Two-decimal text of an exact amount."""
    return f"CAST(CAST(round({expr}, 2) AS DECIMAL(28,2)) AS VARCHAR)"


_FAR = "(k % 5 = 0)"
_NOSPLIT = f"(k % 7 = 0 OR ({_FAR} AND k % 41 <> 0))"
_STEM = f"(CASE WHEN {_FAR} THEN '29' ELSE '27' END || 'AAACB' || lpad(CAST(c % 10000 AS VARCHAR), 4, '0') || 'C1Z')"
_RIGHT = check_digit_sql("stem")

cte("books_base", (), f"""
SELECT *, CAST(round(t * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS h FROM (
 SELECT *, CAST(round(amt * r0 * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS t FROM (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DECIMAL(18,2)) AS amt, CAST(o_orderdate AS DATE) AS d,
   CAST(({list(RATE_BY_SLOT)})[o_orderkey % 6 + 1] AS DECIMAL(9,2)) AS r0,
   {category_sql('o_orderkey')} AS category,
   {_STEM.replace('(k ', '(o_orderkey ').replace('(c ', '(o_custkey ')} AS stem FROM orders))""")
cte("books", ("books_base",), f"""
SELECT k AS ord, 'orders!R' || CAST(k + 2 AS VARCHAR) AS source_ref, category, k % 23 = 0 AS ambiguous,
 CAST(k % 100 AS DOUBLE) / 100 AS score,
 CASE WHEN k % 29 = 0 THEN 'USD' WHEN k % 4 <> 0 THEN 'INR' END AS currency,
 CASE WHEN k % 31 <> 0 THEN amt END AS taxable_value,
 CASE WHEN k % 13 <> 0 THEN r0 END AS gst_rate,
 CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 10 = 0 THEN CAST(CAST(r0 AS INT) AS VARCHAR) || '.0'
      ELSE CAST(CAST(r0 AS INT) AS VARCHAR) END END AS gst_rate_text,
 CAST(CASE WHEN NOT {_NOSPLIT} THEN CASE WHEN k % 37 = 0 THEN h + 5 ELSE h END END AS DECIMAL(19,2)) AS cgst,
 CAST(CASE WHEN NOT {_NOSPLIT} THEN t - h END AS DECIMAL(19,2)) AS sgst,
 CAST(CASE WHEN k % 7 <> 0 AND {_FAR} THEN t END AS DECIMAL(19,2)) AS igst,
 CAST(CASE WHEN k % 71 = 0 THEN 10 END AS DECIMAL(19,2)) AS cess,
 CAST(CASE WHEN k % 21 = 0 THEN NULL WHEN k % 7 = 0 THEN t WHEN k % 43 = 0 THEN t + 9 WHEN k % 3 = 0 THEN t END AS DECIMAL(19,2)) AS total_tax,
 CAST(CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 47 = 0 THEN amt + t + 50 ELSE amt + t END END AS DECIMAL(20,2)) AS total_amount,
 CASE WHEN category IN ('Receipt', 'Payment') THEN amt END AS amount,
 CASE WHEN k % 59 = 0 THEN NULL WHEN k % 53 = 0 THEN 'INV-DUP' || CAST(k % 4 AS VARCHAR) ELSE 'INV-' || CAST(k AS VARCHAR) END AS invoice_number,
 CASE WHEN k % 61 <> 0 THEN d END AS invoice_date,
 CAST(NULL AS VARCHAR) AS supplier_gstin, CAST(NULL AS VARCHAR) AS recipient_gstin,
 CASE WHEN k % 17 <> 0 THEN stem || CASE WHEN k % 19 = 0 THEN '!' WHEN k % 67 = 0
      THEN CASE WHEN {_RIGHT} = '0' THEN '1' ELSE '0' END ELSE {_RIGHT} END END AS party_gstin,
 CASE WHEN category NOT IN ('Sales', 'Export', 'Sales Return / Credit Note') THEN 'Party ' || CAST(c AS VARCHAR) END AS supplier_name,
 CASE WHEN category IN ('Sales', 'Export', 'Sales Return / Credit Note') THEN 'Party ' || CAST(c AS VARCHAR) END AS customer_name,
 CASE WHEN k % 20 IN (14, 15) AND k % 3 <> 0 THEN 'INV-' || CAST(k - 1 AS VARCHAR) END AS original_invoice_ref,
 CASE WHEN k % 19 = 0 THEN 'L' || CAST(k % 7 AS VARCHAR) END AS ledger,
 CASE WHEN k % 19 = 0 THEN amt END AS opening_balance,
 CASE WHEN k % 19 = 0 AND k % 3 <> 0 THEN CAST(amt + CASE WHEN k % 31 <> 0 THEN amt ELSE 0 END - t
      + CASE WHEN k % 133 = 0 THEN 1 ELSE 0 END AS DECIMAL(22,2)) END AS closing_balance,
 CASE WHEN k % 19 = 0 AND k % 31 <> 0 THEN amt END AS debit, CASE WHEN k % 19 = 0 THEN t END AS credit
FROM books_base""")

_GROUP_SQL = ("CASE WHEN category IN ('Sales', 'Export') THEN 'outward' WHEN category IN ('Purchase', 'Import') THEN 'inward' "
              "WHEN category = 'Sales Return / Credit Note' THEN 'credit_notes' "
              "WHEN category = 'Purchase Return / Debit Note' THEN 'debit_notes' WHEN category = 'Receipt' THEN 'receipts' "
              "WHEN category = 'Payment' THEN 'payments' WHEN category = 'Expense' THEN 'expenses' ELSE 'other' END")
_BIZ = lit(business_gstin())
_N = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in schema.COMPONENTS)
_SUM = " + ".join(f"coalesce({c}, 0)" for c in schema.COMPONENTS)
cte("feat0", ("books",), f"""
SELECT *, {_GROUP_SQL} AS grp, {_N} AS n_components FROM books""")
cte("feat1", ("feat0",), f"""
SELECT ord, source_ref, category, grp, ambiguous, score, coalesce(currency, 'INR') AS currency,
 currency IS NOT NULL AS currency_stated, coalesce(currency, 'INR') = 'INR' AS in_base_currency,
 taxable_value AS taxable, gst_rate AS rate, gst_rate_text AS rate_text, cgst, sgst, igst, cess, n_components,
 total_tax AS reported_total_tax, CASE WHEN n_components > 0 THEN {_SUM} ELSE total_tax END AS tax,
 total_amount, amount, invoice_number, invoice_date,
 CASE WHEN grp IN ('outward', 'credit_notes') THEN coalesce(nullif(supplier_gstin, ''), {_BIZ})
      ELSE coalesce(nullif(supplier_gstin, ''), party_gstin) END AS supplier_gstin,
 CASE WHEN grp IN ('outward', 'credit_notes') THEN coalesce(nullif(recipient_gstin, ''), party_gstin)
      ELSE coalesce(nullif(recipient_gstin, ''), {_BIZ}) END AS recipient_gstin,
 CASE WHEN grp IN ('outward', 'credit_notes') THEN coalesce(nullif(customer_name, ''), supplier_name)
      ELSE coalesce(nullif(supplier_name, ''), customer_name) END AS party_name,
 original_invoice_ref, ledger, opening_balance, closing_balance, debit, credit
FROM feat0""")
cte("feat2", ("feat1",), f"""
SELECT *, {gstin_status_sql('supplier_gstin')} AS supplier_gstin_status,
 {gstin_status_sql('recipient_gstin')} AS recipient_gstin_status FROM feat1""")
cte("features", ("feat2",), """
SELECT *, supplier_gstin_status = 'valid' AND coalesce(invoice_number, '') <> '' AND invoice_date IS NOT NULL
 AND coalesce(tax > 0, false) AS has_itc_evidence FROM feat2""")

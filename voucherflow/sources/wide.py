"""Wide worksheet rows derived from orders: every rule, its conflicts and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.operators.features import once_each
from voucherflow.sources.tables import spread, table

# One line per slot (order key modulo 30): expected category, then Column=value pairs.
# {k} is the order key, {a} the order total with two decimals.
SHEET = """
Rejection In;Rejection Note No=RJN-IN-{k};Item Rejected=Bolts;Quantity Rejected=4;Rejection Reason=Damaged;GRN Reference=GRN{k};Receiving Company=Acme Works;Rejection Date=2024-03-05
Rejection Out;Rejection Note No=RJN-OUT-{k};Item Rejected=Nuts;Quantity Rejected=9;Rejection Reason=Late;DN Reference=DC{k};Customer=Beta Retail
Purchase Return / Debit Note;Document Number=DBN-{k};Vendor Name=Gamma Mills;Units Returned=3;Reason for Return=Torn;Original Doc Ref=PUR-{k}
Sales Return / Credit Note;Document Number=CRN-{k};Vendor Name=Gamma Mills;Units Returned=2;Reason for Return=Wrong size;Original Invoice Ref=SAL-{k}
Purchase;Document Number=PUR-{k};PO Ref=PO{k};Vendor Name=Gamma Mills;Product=Yarn;Base Amount={a};Tax Amount=18.50
Sales;Document Number=SAL-{k};Delivery Ref=DN{k};Product=Cloth;Company=Acme Works;Base Amount={a}
Purchase Order;PO Number=PO{k};Supplier=Delta Parts;Quantity Required=40;Promised Delivery=2024-04-01;Ordering Company=Acme Works;Unit Rate=12.50;Item=Valves
Sales Order;SO Number=SO{k};Customer=Beta Retail;Quantity Ordered=12;Selling Company=Acme Works;SO Date=2024-02-10
Delivery Note;Delivery Challan No=DC{k};Item Dispatched=Pumps;Quantity Shipped=6;Dispatch Date=2024-02-11
Receipt Note;GRN Number=GRN{k};Item Received=Pipes;Quantity Received=30;PO Reference=PO{k};Receiving Company=Acme Works
Contra;Contra ID=CTR{k};Source Account=Cash;Destination Account=Bank;Transfer Amount={a};Transfer Purpose=Cash deposit
Payment;Payment ID=PMT-{k};Payer Organization=Acme Works;Payee Organization=Delta Parts;Payment Amount={a};Payment Type=NEFT;Payment Currency=INR
Receipt;Receipt ID=RCP{k};Received Amount={a};Receipt Nature=Invoice;Receiving Organization=Acme Works
Salary / Payroll;Employee Code=EMP{k};Gross Salary={a};Net Payable=900.00;Payroll Period=2024-02
Expense;Expense Claim No=EXP{k};Expense Type=Travel;Amount Claimed={a};Claim Date=2024-02-12;Notes=Taxi fare
Export;Export Invoice No=EXP{k};Destination Country=Kenya;Units Exported=8;Free on Board Value={a};Exporter=Acme Works;Importer=Nairobi Ltd
Import;Import Bill No=IBL{k};Originating Country=Japan;Units Imported=5;Customs Duty=70.00;Import GST=12.00
Journal;Journal ID=JNL{k};Debit Side=Rent;Credit Side=Cash;Journal Type=Accrual;Narration=Month end
Stock Journal;Stock Adj ID=SA{k};Adjustment Qty=-3;Storage Facility=Depot 1;Reason=Breakage
Physical Stock;Stock Count ID=SC{k};Book Quantity=50;Counted Quantity=48;Count Date=2024-03-31
Job Work In Order;JWIO Ref=JWIO{k};Processing Rate=4.00;Processor=Epsilon Dyers
Job Work Out Order;JWOO Ref=JWOO{k};Service Charge=35.00;Agreement Terms=30 days
Material In;Inward Job Work No=MIW{k};Subcontractor=Epsilon Dyers;Quantity Sent=11;Date of Dispatch=2024-01-09;Material=Dye
Material Out;Outward Job Work No=MOW{k};Contractor=Zeta Forge;Quantity Received=7;Date of Receipt=2024-01-19
Payment;Payment ID=PMT-{k};Payer Organization=Acme Works;Payee Organization=Delta Parts;Payment Amount={a};Contra ID=CTR{k}
Purchase Return / Debit Note;Document Number=DBN-{k}
Rejection In;Item Rejected=Bolts;Quantity Rejected=4;Rejection Reason=Damaged;Supplier=Delta Parts
Sales Return / Credit Note;Document Number=DBN-{k};Vendor Name=Gamma Mills;Units Returned=2;Reason for Return=Wrong size;Original Invoice Ref=SAL-{k}
Purchase Order;Supplier=Delta Parts;Quantity Required=40;Description=Valves
Other / Miscellaneous
"""


def slots() -> list[tuple[str, dict[str, str]]]:
    out = []
    for line in SHEET.strip().splitlines():
        label, *cells = line.split(";")
        out.append((label, dict(c.split("=", 1) for c in cells)))
    return out


WIDE_COLUMNS = tuple(dict.fromkeys(
    [c for _, cells in slots() for c in cells] + list(schema.OWN_ID_COLUMNS)))
AT_ONCE = 10    # columns made in one step
# Own numbers get noise: blanks around them (k % 11 = 0), a null token (k % 7 = 0), a neutral number (k % 13 = 0).


def _value(text: str, k: Column, amount: Column) -> Column:
    parts: list[Column] = []
    rest = text
    while rest:
        for mark, col in (("{k}", k), ("{a}", amount)):
            if rest.startswith(mark):
                parts.append(col)
                rest = rest[3:]
                break
        else:
            cut = min([p for p in (rest.find("{k}"), rest.find("{a}")) if p >= 0], default=len(rest))
            parts.append(F.lit(rest[:cut]))
            rest = rest[cut:]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def wide_vouchers(spark: SparkSession, folder: str) -> DataFrame:
    o = spread(table(spark, folder, "orders")).select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("a"),
        (F.col("o_orderkey") % 30).cast("int").alias("slot"), F.col("o_orderkey").cast("string").alias("ks"))
    k, c = F.col("k"), F.col
    plain, noisy = {}, {}
    for i, name in enumerate(WIDE_COLUMNS):
        value = None
        for slot, (_, cells) in enumerate(slots()):
            if name in cells:
                v = _value(cells[name], c("ks"), c("a"))
                value = F.when(c("slot") == slot, v) if value is None else value.when(c("slot") == slot, v)
        value = value if value is not None else F.lit(None).cast("string")
        if name not in schema.OWN_ID_COLUMNS:
            plain[name] = value
            continue
        plain[f"__o{i}"], value = value, c(f"__o{i}")
        noisy[name] = F.when(value.isNull(), None).when(k % 7 == 0, " NaN ").when(k % 13 == 0, F.concat(F.lit("DOC-"), c("ks"))) \
            .when(k % 11 == 0, F.concat(F.lit("  "), value, F.lit(" "))).otherwise(value)
    o = once_each(once_each(o, plain, AT_ONCE), noisy, AT_ONCE)
    label = F.element_at(F.array(*[F.lit(l) for l, _ in slots()]), c("slot") + 1)
    return o.select(k.alias("ord"), F.concat(F.lit("wide!R"), (k + 2).cast("string")).alias("source_ref"),
                    *[c(f"`{n}`") for n in WIDE_COLUMNS], label.alias(schema.LABEL_COLUMN))


def wide_sql() -> str:
    """The same table as DuckDB text."""
    def value(text: str) -> str:
        out = "'" + text.replace("'", "''") + "'"
        return "(" + out.replace("{k}", "' || ks || '").replace("{a}", "' || a || '") + ")"

    columns = []
    for name in WIDE_COLUMNS:
        arms = [f"WHEN slot = {i} THEN {value(cells[name])}" for i, (_, cells) in enumerate(slots()) if name in cells]
        expr = f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS VARCHAR)"
        if name in schema.OWN_ID_COLUMNS and arms:
            expr = (f"CASE WHEN ({expr}) IS NULL THEN NULL WHEN k % 7 = 0 THEN ' NaN ' WHEN k % 13 = 0 THEN 'DOC-' || ks "
                    f"WHEN k % 11 = 0 THEN '  ' || ({expr}) || ' ' ELSE ({expr}) END")
        columns.append(f'{expr} AS "{name}"')
    labels = ", ".join("'" + l + "'" for l, _ in slots())
    return (f"SELECT k AS ord, 'wide!R' || CAST(k + 2 AS VARCHAR) AS source_ref, {', '.join(columns)}, "
            f"([{labels}])[slot + 1] AS \"{schema.LABEL_COLUMN}\" FROM (SELECT o_orderkey AS k, "
            f"CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a, o_orderkey % 30 AS slot, "
            f"CAST(o_orderkey AS VARCHAR) AS ks FROM orders)")

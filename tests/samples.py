"""Hand-built records with known answers."""

from voucherflow import schema

CHARS = schema.BASE36


def gstin(state: str, pan: str) -> str:
    stem = f"{state}{pan}1Z"
    parts = [CHARS.index(ch) * (1 + i % 2) for i, ch in enumerate(stem)]
    return stem + CHARS[-sum(p // 36 + p % 36 for p in parts) % 36]


BUSINESS = gstin("27", "AAACB1234C")
OTHER_STATE = gstin("29", "AADCS3456F")


def sale(**change) -> dict:
    row = {"Kind": "Sales", "Invoice No": "S-001", "Invoice Date": "2026-09-05", "Customer": "Gamma Retail",
           "Customer GSTIN": gstin("27", "AABCC5678D"), "Taxable Value": "10000", "GST Rate": "18", "CGST": "900",
           "SGST": "900", "Invoice Value": "11800"}
    return {**row, **change}


def purchase(**change) -> dict:
    row = {"Kind": "Purchase", "Invoice No": "P-77", "Invoice Date": "2026-09-06", "Supplier": "Beta Supplies",
           "Supplier GSTIN": gstin("27", "AACCS9012E"), "Taxable Value": "5000", "GST Rate": "18", "CGST": "450",
           "SGST": "450", "Invoice Value": "5900"}
    return {**row, **change}


PAYMENT = {"Payment ID": "PMT-884", "Payer Organization": "Acme", "Payee Organization": "Beta", "Payment Amount": "500", "Payment Type": "NEFT"}
CONTRA = {"Contra ID": "CTR-11", "Source Account": "Cash", "Destination Account": "Bank", "Transfer Amount": "90"}
DEBIT_NOTE = {"Document Number": "DBN-3", "Vendor Name": "Beta", "Units Returned": "4", "Reason for Return": "Torn", "Original Doc Ref": "PUR-9"}
CREDIT_NOTE = {"Document Number": "CRN-3", "Vendor Name": "Beta", "Units Returned": "4", "Reason for Return": "Torn", "Original Invoice Ref": "SAL-9"}
REJECTION_IN = {"Rejection Note No": "RJN-IN-5", "Item Rejected": "Bolt", "Quantity Rejected": "2", "Rejection Reason": "Bent",
                "GRN Reference": "GRN7", "Receiving Company": "Acme"}
REJECTION_OUT = {"Rejection Note No": "RJN-OUT-5", "Item Rejected": "Bolt", "Quantity Rejected": "2", "Rejection Reason": "Bent",
                 "DN Reference": "DC7", "Customer": "Gamma"}


def table(spark, rows: list[dict]):
    """Rows with any columns; missing cells are null."""
    names = list(dict.fromkeys(n for r in rows for n in r)) or ["Empty"]
    ddl = "ord bigint, source_ref string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, f"records[{i}]", *[r.get(n) for n in names]) for i, r in enumerate(rows)], ddl)

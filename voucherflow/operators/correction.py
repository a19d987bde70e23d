"""Correction rules over canonical rows, and the keyword classifier of the upload screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow.functions.parsing import fold_space
from voucherflow.operators.features import once

# ---- Fixed values: document types, evidence words and keyword scores. ----
ORDER_TYPES = {"Sales Order": ("sales order", "sales order form"), "Purchase Order": ("purchase order", "purchase order form")}
KEPT_TYPES = ("delivery note", "receipt note", "sales invoice", "purchase invoice", "tax invoice")
KEPT_NOTES = ("credit note", "debit note")
ADVANCE_WORDS = r"\b(advance|prepayment|prepaid)\b"
ADVANCE_STATUS = r"\b(prepaid|prepayment|advance|received in advance)\b"
SALES_NOTE = r"\b(credit note|sales return|customer credit note)\b"
PURCHASE_NOTE = r"\b(debit note|purchase return|supplier debit note)\b"
CUSTOMER_SIDE = r"\b(customer|buyer|sold goods|previously booked sale|sales invoice)\b"
SUPPLIER_SIDE = r"\b(supplier|vendor|goods returned to supplier|purchase invoice)\b"
KEYWORDS = (
    ("Purchase", 96, "purchase|raw material|steel|inventory|freight"),
    ("Sales", 94, "sale|goods|dealer|supply"),
    ("Payment", 89, "payment|settlement|bank|transfer|neft"),
    ("Journal", 72, "journal|rebate|adjustment|credit note"),
    ("Expense", 61, "furniture|office|rent|fuel"),
)
KEYWORD_DEFAULT = ("Expense", 85)
SALES_PARTY = "ltd"
REVIEW_BELOW = 70
# ---- End of fixed values. ----

_INPUTS = ("document_type", "item_description", "transaction_narration", "payment_status", "debit_credit_info",
           "buyer_customer", "seller_supplier")


def _terms(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    text = {n: fold_space(F.col(n)) if n in have else F.lit("") for n in _INPUTS}
    df = once(df, {f"t_{n}": c for n, c in text.items()})
    signals = sum((F.col(f"t_{n}").rlike(p).cast("int") for n, p in (
        ("transaction_narration", ADVANCE_WORDS), ("payment_status", ADVANCE_STATUS))),
        F.col("t_item_description").rlike(ADVANCE_WORDS).cast("int"))
    said = F.concat_ws(" ", "t_item_description", "t_transaction_narration", "t_debit_credit_info")
    return once(once(df, {"t_signals": signals, "t_said": said}), {
        "t_sales_note": F.col("t_said").rlike(SALES_NOTE), "t_purchase_note": F.col("t_said").rlike(PURCHASE_NOTE),
        "t_customer": F.col("t_said").rlike(CUSTOMER_SIDE) | (F.col("t_buyer_customer") != ""),
        "t_supplier": F.col("t_said").rlike(SUPPLIER_SIDE) | (F.col("t_seller_supplier") != "")})


def correct(df: DataFrame, prediction: str = "prediction", version: int = 1) -> DataFrame:
    """Add `corrected` and `correction_reason`; version 2 also reads credit and debit note wording."""
    if version not in (1, 2):
        raise ValueError("version must be 1 or 2")
    c = F.col
    rows = _terms(df)
    kept = KEPT_TYPES + (KEPT_NOTES if version == 1 else ())
    advance = F.concat(F.lit("Advance evidence in "), c("t_signals").cast("string"), F.lit(" fields")) if version == 1 \
        else F.lit("Advance evidence in at least two fields")
    branches: list[tuple[Column, Column, Column]] = []
    for label, types in ORDER_TYPES.items():
        branches.append((c("t_document_type").isin(*types), F.lit(label),
                         F.lit(f"Explicit document_type: {label.lower()}")))
    branches.append((c("t_document_type").isin(*kept), c(prediction),
                     F.lit("Preserved explicit non-order document type")))
    branches.append((c("t_signals") >= 2, F.lit("Advance / Prepayment"), advance))
    if version == 2:
        branches.append((c("t_sales_note") & c("t_customer") & ~c("t_purchase_note"), F.lit("Sales Return / Credit Note"),
                         F.lit("Explicit sales credit-note evidence with customer-side context")))
        branches.append((c("t_purchase_note") & c("t_supplier") & ~c("t_sales_note"), F.lit("Purchase Return / Debit Note"),
                         F.lit("Explicit purchase debit-note evidence with supplier-side context")))
    label = reason = None
    for test, value, why in branches:
        label = F.when(test, value) if label is None else label.when(test, value)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    out = once(rows, {"corrected": label.otherwise(c(prediction)),
                      "correction_reason": reason.otherwise("No correction rule matched")})
    return out.drop(*[n for n in out.columns if n.startswith("t_") and n not in df.columns])


def keyword_class(description: Column, party: Column) -> tuple[Column, Column, Column]:
    """(category, score, status): first keyword list found in the description, in order."""
    text, who = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(party, F.lit("")))
    label = score = None
    for name, points, words in KEYWORDS:
        hit = text.rlike(words)
        if name == "Sales":
            hit = hit | who.contains(SALES_PARTY)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        score = F.when(hit, points) if score is None else score.when(hit, points)
    score = score.otherwise(KEYWORD_DEFAULT[1])
    return label.otherwise(KEYWORD_DEFAULT[0]), score, F.when(score < REVIEW_BELOW, "Review").otherwise("High")


def keyword_candidates(label: Column, score: Column) -> Column:
    """Three fixed-form candidates: the choice, its usual rival, and Payment."""
    rival = F.when(label == "Expense", "Purchase").otherwise("Expense")
    make = lambda name, points: F.struct(name.alias("voucher"), points.cast("int").alias("score"))
    return F.array(make(label, score), make(rival, F.greatest(F.lit(5), F.lit(95) - score)), make(F.lit("Payment"), F.lit(5)))

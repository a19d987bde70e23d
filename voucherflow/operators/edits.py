"""Controlled record edits: change a few fields of a known voucher and see how the first-match rules answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow.functions.parsing import clean_field
from voucherflow.functions.text import neutral_identifier
from voucherflow.operators.features import once

# Case | own-number column | prefix | edits | expectation.
# Edits: '~' makes the number neutral, '-' removes the value, '#X' keeps the digits after X, anything else is the new value.
CASE_TABLE = """
M01|Document Number|DBN|Document Number=~|Purchase Return / Debit Note
M02|Document Number|DBN|Document Number=-|Purchase Return / Debit Note
M03|Document Number|DBN|Document Number=~;Original Doc Ref=~|AMBIGUOUS
M04|Document Number|CRN|Document Number=~|Sales Return / Credit Note
M05|Document Number|CRN|Document Number=-|Sales Return / Credit Note
M06|Document Number|CRN|Document Number=~;Original Invoice Ref=~|AMBIGUOUS
M07|Document Number|CRN|Document Number=#DBN-|CONFLICT
M08|Rejection Note No|RJN-IN|GRN Reference=-|Rejection In
M09|Rejection Note No|RJN-IN|GRN Reference=-;Rejection Note No=~|Rejection In
M10|Rejection Note No|RJN-IN|GRN Reference=-;Receiving Company=-;Rejection Note No=~|AMBIGUOUS
M11|Rejection Note No|RJN-IN|Customer=Retail Networks Inc;DN Reference=DC7129709|CONFLICT
M12|Rejection Note No|RJN-IN|Customer=Retail Networks Inc;DN Reference=DC7129709;Rejection Note No=~|CONFLICT
M13|Rejection Note No|RJN-OUT|GRN Reference=GRN2009152;Receiving Company=Corporate Services Ltd|CONFLICT
M14|Rejection Note No|RJN-OUT|Rejection Note No=#RJN-IN-|CONFLICT (fields: Rejection Out)
M15|Rejection Note No|RJN-IN|Rejection Note No=#RJN-OUT-|CONFLICT (fields: Rejection In)
M16|PO Number|PO|PO Number=-|Purchase Order
M17|PO Number|PO|PO Number=~|Purchase Order
M18|SO Number|SO|SO Number=-|Sales Order
M19|GRN Number|GRN|GRN Number=-;PO Reference=-|Receipt Note
M20|Contra ID|CTR|Contra ID=#PMT-|Contra
M21|Payment ID|PMT|Contra ID=#CTR-|CONFLICT (fields: Payment)
M22|Expense Claim No|EXP|Expense Claim No=~|Expense
M23|Export Invoice No|EXP|Export Invoice No=~|Export
M24|Document Number|PUR-|Document Number=~|AMBIGUOUS
M25|Document Number|SAL-|Document Number=~|Sales
M26|Document Number|SAL-|Document Number=~;Delivery Ref=~|AMBIGUOUS
M27|Stock Count ID|SC|Stock Count ID=#SA|Physical Stock
"""


@dataclass(frozen=True)
class Case:
    name: str
    id_column: str
    prefix: str
    edits: tuple[tuple[str, str], ...]
    expectation: str


def cases() -> tuple[Case, ...]:
    out = []
    for line in CASE_TABLE.strip().splitlines():
        name, column, prefix, edits, expectation = line.split("|")
        out.append(Case(name, column, prefix, tuple(tuple(e.split("=", 1)) for e in edits.split(";")), expectation))
    return tuple(out)


def _edited(case: Case, field: str, how: str) -> Column:
    old = F.col(f"`{field}`")
    if how == "-":
        return F.lit(None).cast("string")
    if how == "~":
        return neutral_identifier(F.coalesce(old, F.lit("")))
    if how.startswith("#"):
        source = F.col(f"`{case.id_column}`")
        return F.concat(F.lit(how[1:]), F.array_join(F.regexp_extract_all(source, F.lit(r"\d+"), 0), ""))
    return F.lit(how)


def edited_rows(df: DataFrame) -> DataFrame:
    """Every row once per case its own number qualifies for, with that case's edits applied."""
    have = set(df.columns)
    usable = [c for c in cases() if c.id_column in have]
    fits = F.array(*[F.when(clean_field(F.col(f"`{c.id_column}`")).startswith(c.prefix), c.name) for c in usable])
    rows = df.withColumn("case_id", F.explode(fits)).filter("case_id IS NOT NULL")
    new: dict[str, Column] = {}
    for c in usable:
        for field, how in c.edits:
            if field in have:
                hit = F.col("case_id") == c.name
                new[field] = new[field].when(hit, _edited(c, field, how)) if field in new else F.when(hit, _edited(c, field, how))
    columns = [new[n].otherwise(F.col(f"`{n}`")).alias(n) if n in new else F.col(f"`{n}`") for n in rows.columns]
    return rows.select(*columns)


def expectation() -> Column:
    pairs = [F.lit(x) for c in cases() for x in (c.name, c.expectation)]
    return F.create_map(*pairs)[F.col("case_id")]


def verdict(expected: Column, rule: Column, predicted: Column, kinds: Column, final: Column) -> Column:
    """How the answer compares with the expectation, in one sentence."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    open_case = expected.startswith("AMBIGUOUS") | expected.startswith("CONFLICT")
    side = F.regexp_extract(expected, r"^CONFLICT \(fields: (.*)\)$", 1)
    return F.when(rule.isNull() & open_case, said("No rule fired; model decided (", final, ") without a review flag")) \
        .when(rule.isNull(), said("No rule fired despite remaining evidence; model decided (", final, ")")) \
        .when(expected == "AMBIGUOUS", said("Rule resolved an ambiguous record via ", kinds)) \
        .when(expected == "CONFLICT", said("Conflict not detected; rule chose ", predicted, " via ", kinds)) \
        .when((side != "") & (predicted == side), said("Followed field evidence (", kinds, "); conflict not flagged")) \
        .when(side != "", said("Followed identifier prefix against field evidence (", kinds, ")")) \
        .when((predicted == expected) & kinds.contains("prefix"), said("Correct, via ", kinds)) \
        .when(predicted == expected, "Correct, via remaining field evidence") \
        .otherwise(said("Contradicted remaining evidence via ", kinds))


def assess(traced: DataFrame, model: Column) -> DataFrame:
    """Verdict per traced row; `model` is the fallback prediction."""
    rows = once(traced, {"expected": expectation(), "kinds": F.replace("clause_kinds", F.lit(" | "), F.lit(" / ")),
                         "final": F.coalesce("rule_prediction", model)})
    return rows.withColumn("verdict", verdict(F.col("expected"), F.col("rule_id"), F.col("rule_prediction"), F.col("kinds"), F.col("final")))

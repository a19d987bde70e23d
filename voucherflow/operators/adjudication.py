"""Reviewer disagreements: kinds, patterns, field conflicts, priorities and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherflow.functions.literals import fixed_table
from voucherflow.functions.parsing import trim_all
from voucherflow.functions.text import narration_verbatim
from voucherflow.operators.ranking import overall_rank

# ---- Fixed values: the abstain label, patterns, wording and priorities. ----
ABSTAINED = "NEEDS_ADJUDICATION"
# disagreement pair -> definition issues, candidate categories
PATTERNS = {
    "Rejection In vs Rejection Out": ("DEF-01", "Rejection In|Rejection Out"),
    "Purchase Return / Debit Note vs Rejection In": ("DEF-02|DEF-01", "Rejection In|Purchase Return / Debit Note"),
    "Payment vs Purchase Return / Debit Note": ("DEF-04", "Purchase Return / Debit Note|Payment"),
    "Contra vs NEEDS_ADJUDICATION": ("DEF-05", "Contra|Payment|Receipt"),
    "Advance / Prepayment vs NEEDS_ADJUDICATION": ("DEF-07", "Advance / Prepayment|Payment|Receipt"),
    "NEEDS_ADJUDICATION vs Sales Return / Credit Note": ("DEF-03", "Sales Return / Credit Note|Rejection Out"),
    "Journal vs NEEDS_ADJUDICATION": ("", "Journal"),
    "NEEDS_ADJUDICATION vs Rejection Out": ("DEF-01|DEF-02", "Rejection Out|Rejection In|Sales Return / Credit Note"),
    "Material Out vs Rejection In": ("DEF-08|DEF-01", "Material Out|Rejection In"),
    "Material In vs Rejection In": ("DEF-08|DEF-01", "Material In|Rejection In"),
    "Sales vs Sales Return / Credit Note": ("", "Sales Return / Credit Note|Sales"),
    "Rejection Out vs Sales Return / Credit Note": ("DEF-02", "Sales Return / Credit Note|Rejection Out"),
    "NEEDS_ADJUDICATION vs Payment": ("DEF-06", "Payment|Expense|Purchase"),
    "Expense vs NEEDS_ADJUDICATION": ("DEF-06", "Expense|Payment"),
    "NEEDS_ADJUDICATION vs Purchase": ("DEF-06", "Purchase|Expense"),
    "NEEDS_ADJUDICATION vs Rejection In": ("DEF-01|DEF-02", "Rejection In|Purchase Return / Debit Note"),
    "both: Rejection In": ("DEF-01", "Rejection In|Rejection Out"),
}
OTHER_POLICY = ("DEF-10", "Other / Miscellaneous (if kept as a class)|Review status (if Other means 'send to review')")
NO_PATTERN = ("", "")
UNCLEAR = r"unclear|unresolved|does not support|manual review|held for review|should not be forced"
OWN_TRANSFER = r"own cash or bank|same entity|own-account"
ACCOUNT_DEPENDENT = ("Payment", "Receipt", "Contra", "Journal", "Purchase Return / Debit Note", "Advance / Prepayment",
                     "Expense", "Purchase")
PRIORITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
# ---- End of fixed values. ----


def text(name: str) -> Column:
    return F.coalesce(trim_all(F.col(name).cast("string")), F.lit(""))


def disagreement_pair(r1: Column, r2: Column) -> Column:
    return F.when(r1 == r2, F.concat(F.lit("both: "), r1)).otherwise(F.concat(F.least(r1, r2), F.lit(" vs "), F.greatest(r1, r2)))


def disagreement_kind(r1: Column, r2: Column, flagged: Column) -> Column:
    return F.when((r1 == ABSTAINED) & (r2 == ABSTAINED), "BOTH_ABSTAINED") \
        .when((r1 == ABSTAINED) | (r2 == ABSTAINED), "ONE_REVIEWER_ABSTAINED") \
        .when(r1 != r2, "CONCRETE_LABEL_CONFLICT").when(flagged, "SAME_LABEL_WITH_QUALITY_FLAG").otherwise("SAME_LABEL")


def pattern_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, "pair definitions candidates", [(k, *v) for k, v in PATTERNS.items()])


def field_conflicts(candidates: Column) -> Column:
    """Contradictions and gaps between the fields of a case, in a fixed order; never a label."""
    narration, status, movement = F.lower(text("transaction_narration")), text("payment_status"), text("movement_reason")
    doc, accounts, item = text("document_type"), text("debit_credit_info"), text("item_description")
    seller, buyer = text("seller_supplier"), text("buyer_customer")
    parties = F.concat_ws(", ", F.nullif(seller, F.lit("")), F.nullif(buyer, F.lit("")))
    some = (seller != "") | (buyer != "")
    two = (seller != "") & (buyer != "") & (seller != buyer)
    only = F.when(seller != "", seller).otherwise(buyer)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    own = narration.rlike(OWN_TRANSFER) & some
    return F.array_compact(F.array(
        F.when(narration.rlike(UNCLEAR), "Narration itself states the event is unclear / held for review"),
        F.when(narration.contains("customer") & (status == "Returned to supplier"),
               "Narration attributes the rejection to a customer, but payment_status = 'Returned to supplier'"),
        F.when(doc.startswith("Material") & (movement == "Quality rejection"),
               said("document_type = '", doc, "' but movement_reason = 'Quality rejection'")),
        F.when(narration.contains("reject") & (movement != "") & (movement != "Quality rejection"),
               said("Narration describes a rejection, but movement_reason = '", movement, "'")),
        F.when(own & two, said("Narration describes an own-account transfer, but party fields name two different parties: ", parties))
        .when(own, said("Narration describes an own-account transfer; party fields name only '", only,
                        "' (confirm this is the entity itself)")),
        F.when(narration.contains("paid or received"), "Narration does not say whether the advance was paid or received"),
        F.when(F.lower(item).contains("advance received") & status.isin("Prepaid", "Paid in advance"),
               said("item_description = '", item, "' but payment_status = '", status, "'")),
        F.when((accounts != "") & ~accounts.rlike("(?i)cash|bank") & accounts.rlike("(?i)payable|receivable"),
               said("debit_credit_info names no cash/bank account: '", accounts, "'")),
        F.when((accounts == "") & F.arrays_overlap(candidates, F.array(*[F.lit(a) for a in ACCOUNT_DEPENDENT])),
               "debit_credit_info is empty (accounts debited/credited not recorded)")))


def cited_evidence(reviewer: int, fields: list[str]) -> Column:
    """What a reviewer cited, with reviewer 1's field names expanded to the record's own values."""
    label, note = text(f"reviewer_{reviewer}_label"), text(f"reviewer_{reviewer}_notes")
    flag = F.coalesce(F.nullif(text(f"reviewer_{reviewer}_data_quality_flag"), F.lit("")), F.lit("none recorded"))
    raw = text(f"reviewer_{reviewer}_evidence_fields")
    if reviewer == 1:
        pairs = [x for f in fields for x in (F.lit(f), F.coalesce(F.nullif(
            trim_all(narration_verbatim(text(f))) if f == "transaction_narration" else text(f), F.lit("")), F.lit("")))]
        record = F.create_map(*pairs)
        names = F.filter(F.transform(F.split(raw, ","), lambda n: trim_all(n)), lambda n: n != "")
        quoted = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.coalesce(F.nullif(record[n], F.lit("")), F.lit("(empty)")))), "; ")
    else:
        quoted = raw
    stance = F.when(label == ABSTAINED, "abstained").otherwise(F.concat(F.lit("chose "), label))
    return F.concat(F.lit(f"Reviewer {reviewer} "), stance, F.lit(" (confidence "), F.col(f"reviewer_{reviewer}_confidence").cast("string"),
                    F.lit("/3, quality flag: "), flag, F.lit("). Note: "), note, F.lit(" Cited: "), quoted)


def priority(kind: Column, definitions: Column, other: Column) -> tuple[Column, Column]:
    """(priority, reason); the first branch that holds decides."""
    open_issue = definitions != ""
    branches = (
        (other, "HIGH", F.lit("Both reviewers abstained on a record that decides the Other / Miscellaneous policy (DEF-10)")),
        ((kind == "CONCRETE_LABEL_CONFLICT") & open_issue, "HIGH",
         F.concat(F.lit("Two concrete labels conflict on an open definition ("), definitions, F.lit(")"))),
        (kind == "CONCRETE_LABEL_CONFLICT", "MEDIUM", F.lit("Two concrete labels conflict; the definition itself is not disputed")),
        (kind == "SAME_LABEL_WITH_QUALITY_FLAG", "MEDIUM", F.concat(
            F.lit("Reviewers agree but a quality flag was raised; label depends on "),
            F.coalesce(F.nullif(definitions, F.lit("")), F.lit("record check")))),
        (open_issue, "MEDIUM", F.concat(F.lit("One reviewer abstained on an open definition ("), definitions, F.lit(")"))),
        (kind == "BOTH_ABSTAINED", "MEDIUM", F.lit("Both reviewers abstained; decide whether any label is supported")),
    )
    level = why = None
    for test, name, reason in branches:
        level = F.when(test, name) if level is None else level.when(test, name)
        why = F.when(test, reason) if why is None else why.when(test, reason)
    return level.otherwise("LOW"), why.otherwise(
        "One reviewer abstained; no open definition issue applies (see Field Conflicts or Gaps)")


def assess(cases: DataFrame) -> DataFrame:
    """Pair, kind, pattern, candidates, conflicts and priority of every case; no shuffle beyond a fixed lookup."""
    c = F.col
    flagged = (text("reviewer_1_data_quality_flag") != "") | ~text("reviewer_2_data_quality_flag").isin("", "NONE")
    r1, r2 = text("reviewer_1_label"), text("reviewer_2_label")
    rows = cases.withColumns({"pair": disagreement_pair(r1, r2), "kind": disagreement_kind(r1, r2, flagged)})
    rows = rows.withColumn("decides_other", (c("kind") == "BOTH_ABSTAINED") & F.lower(text("transaction_narration")).rlike(UNCLEAR))
    rows = rows.join(F.broadcast(pattern_table(cases.sparkSession)), "pair", "left")
    pick = lambda name, i: F.coalesce(name, F.when(c("decides_other"), OTHER_POLICY[i]).otherwise(NO_PATTERN[i]))
    rows = rows.withColumns({"definitions": pick(c("definitions"), 0), "candidates": pick(c("candidates"), 1)})
    rows = rows.withColumn("definitions", F.regexp_replace(F.when(
        (c("kind") == "BOTH_ABSTAINED") & ~c("decides_other"), "").otherwise(c("definitions")), r"\|", ", "))
    listed = F.filter(F.split("candidates", r"\|"), lambda x: x != "")
    named = F.filter(F.array(r1, r2), lambda x: x != ABSTAINED)
    level, why = priority(c("kind"), c("definitions"), c("decides_other"))
    return rows.withColumns({
        "conflicts": F.array_join(field_conflicts(F.concat(listed, F.array(r1, r2))), " | "),
        "candidate_categories": F.array_join(F.array_distinct(F.concat(listed, named)), " | "),
        "priority": level, "priority_reason": why})


def case_number(c: Column) -> Column:
    return F.regexp_extract(c, r"HR-(\d+)", 1).try_cast("bigint")


def link_cases(cases: DataFrame, queue: DataFrame) -> DataFrame:
    """Case HR-n is row n-1 of the review queue; unmatched cases keep null queue columns."""
    return cases.withColumn("queue_row", case_number(F.col("review_case_id")) - 1).join(queue, "queue_row", "left")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def build_queue(cases: DataFrame) -> DataFrame:
    """Rank by priority, then by how common the disagreement is, its name and the case number."""
    rows = assess(cases)
    sizes = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("pair_rows"))     # label pairs: a few hundred at most
    order = F.create_map(*[F.lit(x) for item in PRIORITY_ORDER.items() for x in item])[F.col("priority")]
    rows = rows.join(sizes, "pair").withColumns({"priority_order": order, "case_no": case_number(F.col("review_case_id"))})
    return overall_rank(rows, [("priority_order", True), ("pair_rows", False), ("pair", True)], "case_no", "queue_rank")


def type_table(queue: DataFrame) -> DataFrame:
    return queue.groupBy("pair", "kind", "priority", "definitions").agg(F.count(F.lit(1)).alias("n_records"))


def reconcile(cases: DataFrame) -> DataFrame:
    c = F.col
    return cases.agg(F.count(F.lit(1)).alias("reviewed"), F.countDistinct("review_case_id").alias("unique_ids"),
                     F.count_if(~c("needs_adjudication")).alias("consensus"), F.count_if(c("needs_adjudication")).alias("flagged"))

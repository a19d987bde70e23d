"""Accounting and tax figures with a completeness status.

All figures come out of one conditional aggregation by group (at most eight
rows after the partial aggregate), then small-table arithmetic. Nothing is
collected per row, so the plan holds for any number of transactions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voucherflow import schema
from voucherflow.config import Rules
from voucherflow.functions.literals import fixed_table
from voucherflow.functions.parsing import flag

ROUNDING = "ROUND_HALF_UP to 0.01 after summation"
VALUE = "decimal(28,2)"


def cents(c: Column) -> Column:
    return F.round(c, 2).cast(VALUE)


def document_value() -> Column:
    return F.coalesce(F.col("total_amount"), F.col("amount"))


def _zero_tax() -> Column:
    c = F.col
    return c("group").isin("outward", "inward") & c("taxable").isNotNull() \
        & flag((c("rate") == 0) | flag(c("tax") == 0))


class Measure:
    """One named sum: which rows it looks at, what it adds, and how it is described."""

    def __init__(self, name: str, group: str | None, keep: Column | None, value: Column, method: str, inputs: list[str],
                 notes: list[str] | None = None):
        self.name, self.group, self.keep, self.value = name, group, keep, value
        self.method, self.inputs, self.notes = method, inputs, notes or []


# Method and note wording of each figure.
_TAXABLE = "Sum of taxable_value per row"
_DOCUMENT = "Sum of invoice value (total_amount, else amount) per row"
_CASH = "Sum of total_amount (or amount when total is absent) per row"
_TOTAL_TAX = "Per row: CGST+SGST+IGST+cess when components are present, else reported total tax; summed"
_WITH_EVIDENCE = "Sum of tax on purchase/import/expense rows with a valid supplier GSTIN, invoice number and invoice date"
_NO_EVIDENCE = "Sum of tax on purchase/import/expense rows missing GSTIN, invoice number or date"
_ZERO_TAX = "Taxable value of outward/inward rows with 0 % rate or 0 tax"
_EVIDENCE_NOTE = "Basic documentary evidence only; legal eligibility is not determined."
_NO_EVIDENCE_NOTE = "Not counted in potential ITC."
_ZERO_NOTE = "Nil-rated, exempt, non-GST and zero-rated supplies are not distinguished."
_ITC_NOTE = ("Potential amount only; eligibility, blocked credits, reversals and GSTR-2B matching are not evaluated.")
_NET_NOTE = ("Potential figure before eligibility rules, reversals, interest, fees, cash/credit ledger balances and "
             "reconciliation with GST portal data.")


def measures(rules: Rules) -> list[Measure]:
    c = F.col
    out: list[Measure] = []
    for g in schema.GROUPS:
        if g in ("receipts", "payments"):
            out.append(Measure(f"{g}_amount", g, None, document_value(), _CASH, ["total_amount", "amount"]))
        else:
            out.append(Measure(f"{g}_taxable_value", g, None, c("taxable"), _TAXABLE, ["taxable_value"]))
            out.append(Measure(f"{g}_document_value", g, None, document_value(), _DOCUMENT, ["total_amount", "amount"]))
    for g in schema.TAX_GROUPS:
        for part in schema.COMPONENTS:
            out.append(Measure(f"{g}_{part}", g, c("n_components") > 0, F.coalesce(c(part), F.lit(0).cast("decimal(1,0)")),
                               f"Sum of {part.upper()} on rows that report tax components (unreported component = 0)", [part]))
        out.append(Measure(f"{g}_total_tax", g, None, c("tax"), _TOTAL_TAX, [*schema.COMPONENTS, "total_tax"]))
    itc = c("category").isin(*rules.itc_categories)
    out.append(Measure("itc_tax_with_basic_evidence", None, itc & c("has_itc_evidence"), c("tax"), _WITH_EVIDENCE,
                       ["tax", "supplier_gstin", "invoice_number", "invoice_date"], [_EVIDENCE_NOTE]))
    out.append(Measure("itc_tax_without_basic_evidence", None, itc & ~c("has_itc_evidence") & (c("tax") > 0), c("tax"),
                       _NO_EVIDENCE, ["tax"], [_NO_EVIDENCE_NOTE]))
    out.append(Measure("zero_tax_value", None, _zero_tax(), c("taxable"), _ZERO_TAX, ["taxable_value", "gst_rate", "tax"],
                       [_ZERO_NOTE]))
    return out


ACCOUNTING_NAMES = tuple(
    name for g in schema.GROUPS
    for name in ([f"{g}_amount"] if g in ("receipts", "payments") else [f"{g}_taxable_value", f"{g}_document_value"]))


def _distinct_sums(items: list[Measure]) -> dict[str, tuple[Column | None, Column]]:
    """Aggregates are shared by every figure that adds the same thing; the group key tells them apart."""
    shared: dict[str, tuple[Column | None, Column]] = {}
    for m in items:
        shared.setdefault(_slot(m), (m.keep, m.value))
    return shared


def _slot(m: Measure) -> str:
    return m.name if m.group is None else m.name[len(m.group) + 1:].replace("document_value", "amount")


def group_sums(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per group (base currency only): rows looked at, rows with a value, ambiguous rows, sum, per measure."""
    aggs: list[Column] = []
    for slot, (keep, value) in _distinct_sums(measures(rules)).items():
        looked = flag(keep) if keep is not None else F.lit(True)
        have = looked & value.isNotNull()
        aggs += [F.count(F.when(looked, 1)).alias(f"{slot}__n"), F.count(F.when(have, 1)).alias(f"{slot}__have"),
                 F.count(F.when(have & F.col("ambiguous"), 1)).alias(f"{slot}__amb"),
                 F.sum(F.when(looked, value)).alias(f"{slot}__sum")]
    return f.filter("in_base_currency").groupBy("group").agg(*aggs)


def _figure_cells(sums: DataFrame, spark: SparkSession, items: list[Measure]) -> DataFrame:
    """One row per figure: rows looked at, rows with a value, ambiguous rows and the sum; absent groups give zeros."""
    slots = list(_distinct_sums(items))
    tall = sums.select("group", F.explode(F.array(*[F.struct(
        F.lit(s).alias("slot"), *[F.col(f"{s}__{part}").alias(part) for part in ("n", "have", "amb")],
        F.col(f"{s}__sum").cast("decimal(38,10)").alias("total")) for s in slots])).alias("e")).select("group", "e.*")
    spec = [(m.name, g, _slot(m)) for m in items for g in ([m.group] if m.group else [*schema.GROUPS, "other"])]
    wanted = fixed_table(spark, "name group slot", spec)
    return wanted.join(tall, ["group", "slot"], "left").groupBy("name").agg(
        *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in ("n", "have", "amb")],
        cents(F.sum("total")).alias("total"))


def _combined(terms: list[tuple[int, Column]]) -> Column:
    """struct(value, status, included, missing) of a signed combination of such structs."""
    cells = [cell for _, cell in terms]
    has = lambda status: reduce(lambda a, b: a | b, [cell["status"] == status for cell in cells])
    status = F.when(reduce(lambda a, b: a & b, [cell["status"] == "NOT_APPLICABLE" for cell in cells]), "NOT_APPLICABLE") \
        .when(has("UNRESOLVED"), "UNRESOLVED").when(has("INCOMPLETE"), "INCOMPLETE").otherwise("COMPLETE")
    zero = F.lit(0).cast(VALUE)
    total = reduce(lambda a, b: a + b, [F.coalesce(cell["value"], zero) * F.lit(sign) for sign, cell in terms])
    add = lambda field: reduce(lambda a, b: a + b, [cell[field] for cell in cells])
    return F.struct(F.when(status != "UNRESOLVED", cents(total)).alias("value"), status.alias("status"),
                    add("included").alias("included"), add("missing").alias("missing"))


# The signed combinations.
OUTPUT_TAX, ITC_LEFT, NET = "output_tax_after_credit_notes", "potential_itc_after_debit_notes", "potential_net_gst_liability"
WITH_EVIDENCE, NO_EVIDENCE = "itc_tax_with_basic_evidence", "itc_tax_without_basic_evidence"
LAST = (OUTPUT_TAX, WITH_EVIDENCE, NO_EVIDENCE, ITC_LEFT, NET, "zero_tax_value")


def calculations(f: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The 43 accounting and tax figures, one row each."""
    spark, items = f.sparkSession, measures(rules)
    c = F.col
    status = F.when(c("n") == 0, "NOT_APPLICABLE").when(c("have") == 0, "UNRESOLVED") \
        .when((c("have") < c("n")) | (c("amb") > 0), "INCOMPLETE").otherwise("COMPLETE")
    cell = F.struct(F.when(c("n") == 0, F.lit(0).cast(VALUE)).otherwise(c("total")).alias("value"), status.alias("status"),
                    c("have").alias("included"), (c("n") - c("have")).alias("missing"))
    extra = F.array_compact(F.array(
        F.when(c("amb") > 0, F.concat(c("amb").cast("string"),
                                      F.lit(" included rows rely on an ambiguous voucher classification"))),
        F.when(c("have") > schema.REFS_SHOWN, F.concat(
            F.lit(f"source_refs lists the first {schema.REFS_SHOWN} of "), c("have").cast("string"), F.lit(" rows")))))
    plain = _figure_cells(group_sums(f, rules), spark, items).select("name", cell.alias("cell"), extra.alias("extra"))
    # A fixed forty rows: fold them to one, add the three combinations, and unfold again.
    one = plain.agg(F.collect_list(F.struct("name", "cell", "extra")).alias("cells"),
                    F.map_from_entries(F.collect_list(F.struct("name", "cell"))).alias("by_name"))
    at = lambda name: F.col("by_name")[name]
    one = one.select("cells", "by_name",
                     _combined([(1, at("outward_total_tax")), (-1, at("credit_notes_total_tax"))]).alias("output"),
                     _combined([(1, at(WITH_EVIDENCE)), (-1, at("debit_notes_total_tax"))]).alias("itc"))
    one = one.withColumn("net", _combined([(1, c("output")), (-1, c("itc"))]))
    left_out = at(NO_EVIDENCE)["included"] + at(NO_EVIDENCE)["missing"]
    lowered = (c("net.status") == "COMPLETE") & (left_out > 0)
    net = F.struct(c("net.value").alias("value"), F.when(lowered, "INCOMPLETE").otherwise(c("net.status")).alias("status"),
                   c("net.included").alias("included"), c("net.missing").alias("missing"))
    none = F.array().cast("array<string>")
    left_note = F.when(lowered, F.array(F.concat(
        left_out.cast("string"), F.lit(" inward rows with tax lack basic ITC evidence and are excluded.")))).otherwise(none)
    entry = lambda name, value, notes: F.struct(F.lit(name).alias("name"), value.alias("cell"), notes.alias("extra"))
    combos = F.array(entry(OUTPUT_TAX, c("output"), none), entry(ITC_LEFT, c("itc"), none), entry(NET, net, left_note))
    rows = one.select(F.explode(F.concat("cells", combos)).alias("e")).select("e.*")
    names = [m.name for m in items if m.name not in LAST] + list(LAST)
    wording = {m.name: (m.method, m.inputs, m.notes) for m in items} | {
        OUTPUT_TAX: ("outward_total_tax - credit_notes_total_tax", ["outward_total_tax", "credit_notes_total_tax"], []),
        ITC_LEFT: (f"{WITH_EVIDENCE} - debit_notes_total_tax", [WITH_EVIDENCE, "debit_notes_total_tax"], [_ITC_NOTE]),
        NET: (f"{OUTPUT_TAX} - {ITC_LEFT}", [OUTPUT_TAX, ITC_LEFT], [_NET_NOTE])}
    words = fixed_table(spark, "name position method inputs_used fixed_notes section", [
        (n, i, *wording[n], "accounting" if n in ACCOUNTING_NAMES else "gst") for i, n in enumerate(names)])
    return rows.join(F.broadcast(words), "name").select(
        "position", "name", c("cell.value").cast("string").alias("value"), c("cell.status").alias("status"), "method",
        "inputs_used", F.lit(rules.base_currency).alias("currency"), F.lit(ROUNDING).alias("rounding"),
        c("cell.included").alias("rows_included"), c("cell.missing").alias("rows_missing"),
        F.concat("fixed_notes", "extra").alias("notes"), "section")


def calculation_refs(f: DataFrame, rules: Rules = Rules(), shown: int = schema.REFS_SHOWN) -> DataFrame:
    """First references behind each figure, in input order.

    The rank filter is pushed below the shuffle (window group limit), so a task
    ships at most `shown` rows per figure however large the figure's group is.
    """
    arms = []
    for m in measures(rules):
        looked = flag(m.keep) if m.keep is not None else F.lit(True)
        mine = F.lit(True) if m.group is None else F.col("group") == m.group
        arms.append(F.when(mine & looked & m.value.isNotNull(), m.name))
    rows = f.filter("in_base_currency").select(
        "ord", "source_ref", F.explode(F.array(*arms)).alias("name")).filter("name IS NOT NULL")
    return first_refs(rows, ["name"], shown)


def first_refs(rows: DataFrame, keys: list[str], shown: int = schema.REFS_SHOWN) -> DataFrame:
    """keys + array of the first `shown` source_ref by ord."""
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("ord", "source_ref"))) \
        .filter(F.col("rn") <= shown)
    pairs = F.array_sort(F.collect_list(F.struct("ord", "source_ref")))
    return ranked.groupBy(*keys).agg(pairs["source_ref"].alias("source_refs"))


def summary_counts(f: DataFrame) -> DataFrame:
    """One row of row counts by currency treatment."""
    base = F.col("in_base_currency")
    return f.agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_if(base).alias("rows_in_base_currency"),
        F.count_if(~base).alias("rows_excluded_foreign_currency"),
        F.count_if(base & ~F.col("currency_stated")).alias("rows_with_assumed_base_currency"))


def counts_by_category(f: DataFrame) -> DataFrame:
    return f.groupBy(F.coalesce(F.col("category"), F.lit("Unclassified")).alias("category")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


def counts_by_group(f: DataFrame) -> DataFrame:
    """Every group with its base-currency row count, zeros included."""
    names = [*schema.GROUPS, "other"]
    counts = f.filter("in_base_currency").agg(
        *[F.count_if(F.col("group") == g).alias(g) for g in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("group"), F.col(g).alias("n_rows")) for g in names])).alias("e")).select("e.*")


def calculation_checks(calcs: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Every figure's status, followed by one check per ledger."""
    from_calcs = calcs.select("name", "status", "rows_included", "rows_missing")
    from_ledgers = ledgers.select(
        F.concat(F.lit("ledger_balance:"), F.col("ledger")).alias("name"),
        F.when(F.col("reconciles"), "COMPLETE").when(F.col("reconciles").isNull(), "UNRESOLVED")
        .otherwise("INCOMPLETE").alias("status"),
        F.col("n_rows").alias("rows_included"),
        F.lit(0).cast("bigint").alias("rows_missing"))
    return from_calcs.unionByName(from_ledgers)


def ledger_balances(f: DataFrame) -> DataFrame:
    """Opening + debits - credits against the reported closing, per ledger, base currency only."""
    c = F.col
    zero = F.lit(0).cast("decimal(1,0)")
    rows = f.filter(c("in_base_currency") & (c("ledger") != "")
                    & (c("opening_balance").isNotNull() | c("closing_balance").isNotNull()))
    sums = rows.groupBy("ledger").agg(
        *[F.sum(F.coalesce(c(k), zero)).alias(a) for k, a in
          (("opening_balance", "opening"), ("debit", "debits"), ("credit", "credits"))],
        F.sum("closing_balance").alias("closing"), F.count(F.lit(1)).alias("n_rows"))
    expected = c("opening") + c("debits") - c("credits")
    return sums.select(
        "ledger", cents(c("opening")).alias("opening"), cents(c("debits")).alias("debits"),
        cents(c("credits")).alias("credits"), cents(c("closing")).alias("closing_reported"),
        cents(expected).alias("closing_computed"), (cents(expected) == cents(c("closing"))).alias("reconciles"), "n_rows")


def ledger_refs(f: DataFrame, shown: int = schema.REFS_SHOWN) -> DataFrame:
    c = F.col
    rows = f.filter(c("in_base_currency") & (c("ledger") != "")
                    & (c("opening_balance").isNotNull() | c("closing_balance").isNotNull()))
    return first_refs(rows.select("ledger", "ord", "source_ref"), ["ledger"], shown)

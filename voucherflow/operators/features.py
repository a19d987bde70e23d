"""One typed feature row per transaction: group, tax, GSTIN roles and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.config import Rules
from voucherflow.functions.gstin import gstin_status
from voucherflow.functions.parsing import MONEY, RATE, first_filled, flag, parse_code

_STRINGS = ("currency", "invoice_number", "supplier_gstin", "recipient_gstin", "party_gstin", "supplier_name",
            "customer_name", "original_invoice_ref", "place_of_supply", "hsn_sac", "ledger")


def group_of(category: Column, rules: Rules = Rules()) -> Column:
    """Accounting group of a category; the first group that lists it wins, anything else is 'other'.

    The lookup folds to one literal map, so it stays a single node wherever the optimizer inlines it.
    """
    first: dict[str, str] = {}
    for group, members in rules.groups().items():
        for member in members:
            first.setdefault(member, group)
    if not first:
        return F.lit("other")
    pairs = [F.lit(text) for item in first.items() for text in item]
    return F.coalesce(F.create_map(*pairs)[category], F.lit("other"))


def own_series(category: Column, rules: Rules = Rules()) -> Column:
    """Documents the business issues itself: it is the supplier on them."""
    return flag(group_of(category, rules).isin(*schema.OWN_SERIES_GROUPS))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that must be evaluated once per row.

    A plain projection would be inlined into every filter above it; a one-element
    generator is not, while filters on the other columns still pass below it.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)


def once_each(df: DataFrame, columns: dict[str, Column], at_a_time: int) -> DataFrame:
    """`once`, a few columns at a time, where none reads another.

    Each step becomes a method of its own. All columns in one step would pass the size beyond which the JVM no longer
    compiles a method, and every row would then be interpreted.
    """
    names = list(columns)
    for start in range(0, len(names), at_a_time):
        df = once(df, {n: columns[n] for n in names[start:start + at_a_time]})
    return df


def complete_columns(tx: DataFrame) -> DataFrame:
    """Add any canonical field the input lacks as a typed null, so every operator can rely on it."""
    have = set(tx.columns)
    missing = {name: F.lit(None).cast(MONEY) for name in schema.MONEY_FIELDS if name not in have}
    missing |= {name: F.lit(None).cast("string") for name in _STRINGS if name not in have}
    if "gst_rate" not in have:
        missing["gst_rate"] = F.lit(None).cast(RATE)
    if "gst_rate_text" not in have:
        missing["gst_rate_text"] = (F.col("gst_rate") if "gst_rate" in have else F.lit(None)).cast("string")
    if "invoice_date" not in have:
        missing["invoice_date"] = F.lit(None).cast("date")
    return tx.withColumns(missing) if missing else tx


def row_tax(components: dict[str, Column], reported: Column) -> tuple[Column, Column]:
    """(tax, number of components present): the sum of what is present, else the reported total."""
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in components.values()])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0).cast("decimal(1,0)")) for c in components.values()])
    return F.when(count > 0, total).otherwise(reported), count


def with_classification(tx: DataFrame, cls: DataFrame) -> DataFrame:
    """Left lookup of the classifier result by row reference; both sides carry one row per reference."""
    wanted = cls.select("source_ref", "category", "score", "ambiguous")
    return tx.drop("category", "score", "ambiguous").join(wanted, "source_ref", "left")


def features(tx: DataFrame, rules: Rules = Rules(), business_gstin: str | None = None,
             classifications: DataFrame | None = None) -> DataFrame:
    """Row-local: no shuffle unless classifications come as a separate table."""
    if classifications is not None:
        tx = with_classification(tx, classifications)
    tx = complete_columns(tx)
    for name, kind in (("category", "string"), ("score", "double"), ("ambiguous", "boolean"), ("ord", "bigint")):
        if name not in tx.columns:
            tx = tx.withColumn(name, F.lit(None).cast(kind))
    business = F.lit((business_gstin or "").replace(" ", "").upper() or None).cast("string")
    c = F.col
    own = own_series(c("category"), rules)
    tax, present = row_tax({k: c(k) for k in schema.COMPONENTS}, c("total_tax"))
    base = tx.withColumn("group", group_of(c("category"), rules))
    rows = base.select(
        "ord", "source_ref", "category", "group", flag(c("ambiguous")).alias("ambiguous"), "score",
        F.coalesce(c("currency"), F.lit(rules.base_currency)).alias("currency"),
        c("currency").isNotNull().alias("currency_stated"),
        (F.coalesce(c("currency"), F.lit(rules.base_currency)) == rules.base_currency).alias("in_base_currency"),
        c("taxable_value").alias("taxable"), c("gst_rate").alias("rate"), c("gst_rate_text").alias("rate_text"),
        *schema.COMPONENTS, present.alias("n_components"), c("total_tax").alias("reported_total_tax"),
        tax.alias("tax"), "total_amount", "amount", "invoice_number", "invoice_date",
        F.when(own, F.coalesce(first_filled(c("supplier_gstin")), business))
        .otherwise(F.coalesce(first_filled(c("supplier_gstin")), c("party_gstin"))).alias("supplier_gstin"),
        F.when(own, F.coalesce(first_filled(c("recipient_gstin")), c("party_gstin")))
        .otherwise(F.coalesce(first_filled(c("recipient_gstin")), business)).alias("recipient_gstin"),
        F.when(own, F.coalesce(first_filled(c("customer_name")), c("supplier_name")))
        .otherwise(F.coalesce(first_filled(c("supplier_name")), c("customer_name"))).alias("party_name"),
        "original_invoice_ref", "place_of_supply", "hsn_sac", "ledger", "opening_balance", "closing_balance",
        "debit", "credit")
    rows = once(rows, {f"{side}_gstin_status": gstin_status(c(f"{side}_gstin"), rules.verify_gstin_checksum)
                       for side in ("supplier", "recipient")})
    return rows.withColumn("has_itc_evidence", itc_evidence())


def components_present() -> Column:
    """Sorted names of the tax components a row reports."""
    named = [F.when(F.col(k).isNotNull(), k) for k in sorted(schema.COMPONENTS)]
    return F.array_compact(F.array(*named))


def itc_evidence() -> Column:
    """Valid supplier GSTIN, a number, a date and a positive tax."""
    c = F.col
    return flag((c("supplier_gstin_status") == "valid") & (c("invoice_number") != "")
                & c("invoice_date").isNotNull() & (c("tax") > 0))


def normalise_business_gstin(text: str | None) -> str | None:
    return (text or "").replace(" ", "").upper() or None


def status_of_text(df: DataFrame, column: str, verify: bool = True) -> DataFrame:
    return df.withColumn("gstin_status", gstin_status(parse_code(F.col(column)), verify))

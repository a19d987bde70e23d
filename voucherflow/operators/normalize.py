"""Raw text rows to the canonical typed schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.config import Limits
from voucherflow.functions import parsing as P
from voucherflow.functions.text import SENSITIVE_NAMES
from voucherflow.operators.features import once, once_each

AT_ONCE = 4     # cells cleaned or parsed in one step
PROVENANCE = ("ord", "source_ref", "source_sheet", "source_row")


def fold_name(header: str) -> str:
    return re.sub(r"\s+", " ", header).strip().lower()


def canonical_header(c: Column) -> Column:
    """Canonical field of a header value, null when it is not one of the known aliases."""
    pairs = [F.lit(x) for item in schema.alias_lookup().items() for x in item]
    return F.create_map(*pairs)[P.fold_header(c)]


def rename_plan(columns: list[str]) -> dict[str, list[str]]:
    """Canonical field -> source columns that feed it, in source order."""
    lookup, plan = schema.alias_lookup(), {}
    for name in columns:
        field = lookup.get(fold_name(name))
        if field:
            plan.setdefault(field, []).append(name)
    return plan


def dropped_columns(columns: list[str]) -> list[str]:
    return sorted(c for c in columns if fold_name(c) in schema.DROPPED_HEADERS)


def drop_labels(df: DataFrame) -> DataFrame:
    """Label-bearing and output columns never reach analysis."""
    return df.drop(*dropped_columns(df.columns))


def _clean(df: DataFrame, name: str, max_chars: int | None) -> Column:
    cell, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind in ("double", "float"):
        return P.clean_number_cell(cell)
    if kind == "timestamp":
        return F.date_format(cell, "yyyy-MM-dd")
    return P.clean_cell(cell, max_chars)


def clean_cells(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Every data column as cleaned text."""
    return df.select(*[F.col(c) if c in PROVENANCE else _clean(df, c, max_chars).alias(c) for c in df.columns])


def _clean_mapped_cells(df: DataFrame, max_chars: int | None) -> DataFrame:
    """The cleaned cells of the columns that feed a canonical field, a few at a time."""
    data = [c for c in df.columns if c not in PROVENANCE and fold_name(c) in schema.alias_lookup()]
    base = [c for c in df.columns if c in PROVENANCE]
    made = once_each(df.select(*base, *[F.col(f"`{c}`") for c in data]), {f"__k{i}": _clean(df, c, max_chars) for i, c in enumerate(data)}, AT_ONCE)
    return made.select(*base, *[F.col(f"__k{i}").alias(c) for i, c in enumerate(data)])


def _bare_text(field: str, cell: Column) -> Column:
    """Text of a cell before it is parsed."""
    if field in schema.MONEY_FIELDS:
        return P.money_text(cell)
    if field == "gst_rate":
        return P.rate_text(cell)
    if field == "invoice_date":
        return P.parse_date(cell).cast("string")
    if field in schema.GSTIN_FIELDS:
        return P.parse_code(cell)
    return F.upper(P.trim_all(cell)) if field == "currency" else P.trim_all(cell)


def _parsed_text(field: str, bare: Column) -> Column:
    """Comparable text of a parsed cell; null when the cell does not parse."""
    if field in schema.MONEY_FIELDS:
        return F.when(bare.try_cast(P.MONEY).isNotNull(), bare)
    return F.when(bare.try_cast(P.RATE).isNotNull(), bare) if field == "gst_rate" else bare


def _fails(field: str, cell: Column, bare: Column, parsed: Column) -> Column:
    """A date that is no date, or the text of a number that does not parse."""
    return (cell if field == "invoice_date" else bare).isNotNull() & parsed.isNull()


def _typed(field: str, text: Column) -> Column:
    if field in schema.MONEY_FIELDS:
        return text.try_cast(P.MONEY)
    if field == "gst_rate":
        return text.try_cast(P.RATE)
    return text.cast("date") if field == "invoice_date" else text


def extract_fields(df: DataFrame) -> DataFrame:
    """Canonical fields by the first source column that parses, with per-cell warnings.

    Each source cell is parsed once; a later column that disagrees with the value
    kept is reported, never merged.
    """
    plan = rename_plan([c for c in df.columns if c not in PROVENANCE])
    bare: dict[str, Column] = {}
    texts: dict[str, Column] = {}
    keys: dict[tuple[str, str], str] = {}
    for field, sources in plan.items():
        for i, name in enumerate(sources):
            keys[field, name] = f"__{field}_{i}"
            bare[f"__{field}_{i}_bare"] = _bare_text(field, F.col(f"`{name}`"))
            texts[f"__{field}_{i}"] = _parsed_text(field, F.col(f"__{field}_{i}_bare"))
    parsed = once_each(once_each(df, bare, 1), texts, AT_ONCE)
    picked = {field: F.coalesce(*[F.col(keys[field, n]) for n in sources]) for field, sources in plan.items()}
    warnings = {}
    order = [n for n in df.columns if n not in PROVENANCE]
    for name in order:
        field = schema.alias_lookup().get(fold_name(name))
        if field not in plan:
            continue
        mine, cell = F.col(keys[field, name]), F.col(f"`{name}`")
        if field in (*schema.MONEY_FIELDS, "gst_rate", "invoice_date"):
            kind = "a date" if field == "invoice_date" else "a number"
            warnings[f"__w{len(warnings)}"] = F.when(_fails(field, cell, F.col(f"{keys[field, name]}_bare"), mine), F.concat(
                F.lit(f"Column '{name}': not {kind}: "), F.substring(cell, 1, 40)))
        if plan[field].index(name) > 0:
            earlier = F.coalesce(*[F.col(keys[field, n]) for n in plan[field][:plan[field].index(name)]])
            warnings[f"__w{len(warnings)}"] = F.when(mine != earlier, F.lit(
                f"Column '{name}' conflicts with another column mapped to {field}; first value kept"))
    parsed = once_each(parsed, warnings, AT_ONCE)
    notes = F.array_compact(F.array(*[F.col(n) for n in warnings])) if warnings else F.array().cast("array<string>")
    if warnings:
        parsed = once(parsed, {"parse_warnings": notes})
        notes = F.col("parse_warnings")
    typed = {field: _typed(field, text) for field, text in picked.items()}
    if "gst_rate" in picked:
        typed["gst_rate_text"] = picked["gst_rate"]
    base = [F.col(c) for c in df.columns if c in PROVENANCE]
    return parsed.select(*base, *[c.alias(n) for n, c in typed.items()], notes.alias("parse_warnings"))


def raw_map(df: DataFrame) -> Column:
    """Non-empty cells by column name."""
    names = [c for c in df.columns if c not in PROVENANCE]
    pairs = [x for n in names for x in (F.lit(n.strip()), F.col(f"`{n}`"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def normalize(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Clean cells, drop label columns and extract canonical fields."""
    return extract_fields(_clean_mapped_cells(drop_labels(df), limits.max_cell_chars))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    data = [c for c in df.columns if c not in PROVENANCE]
    return df.dropna("all", subset=data) if data else df


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value: one counting pass, one row out, then one row per column."""
    names = [c for c in df.columns if c not in PROVENANCE]
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("filled"))
                                             for i, n in enumerate(names)])).alias("e")).select("e.*").filter("filled = 0")


def warning_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.size("parse_warnings")).cast("bigint").alias("warnings"),
                  F.count_if(F.size("parse_warnings") > 0).alias("rows_with_warnings"))


def limit_report(df: DataFrame, limits: Limits, sheet: str | None = None) -> DataFrame:
    """Sizes against the configured limits, as data; limits that are None are not enforced."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if sheet:
        aggs.append(F.countDistinct(sheet).alias("sheets"))
    sizes = df.agg(*aggs)
    checks = [("rows", F.col("rows"), limits.max_rows), ("columns", F.lit(len(df.columns)).cast("bigint"), limits.max_columns)]
    if sheet:
        checks.append(("sheets", F.col("sheets"), limits.max_sheets))
    return sizes.select(F.explode(F.array(*[F.struct(
        F.lit(name).alias("limit_name"), value.alias("observed"), F.lit(cap).cast("bigint").alias("allowed"),
        F.coalesce(value <= F.lit(cap), F.lit(True)).alias("within")) for name, value, cap in checks])).alias("e")).select("e.*")


def wide_to_canonical(df: DataFrame) -> DataFrame:
    """Wide worksheet columns to the training fields; the first filled source in the fixed order wins."""
    have = set(df.columns)
    out = {}
    for field in schema.WIDE_SOURCES:
        sources = [F.col(f"`{n}`") for n in schema.wide_sources(field) if n in have]
        if sources:
            out[field] = F.coalesce(*sources)
    keys = [F.col(c) for c in df.columns if c in PROVENANCE]
    return df.select(*keys, *[c.alias(n) for n, c in out.items()])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Trim and fold headers; rename common variants when the target is not already there."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])
    for old, new in schema.TRAINING_ALIASES.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def redact(df: DataFrame, keep: tuple[str, ...] = PROVENANCE, shown: int = 200) -> DataFrame:
    """Values under sensitive column names are hidden; other text is shortened."""
    sensitive = re.compile(SENSITIVE_NAMES, re.IGNORECASE)
    kinds = dict(df.dtypes)

    def one(name: str) -> Column:
        cell = F.col(f"`{name}`")
        if name in keep:
            return cell
        if sensitive.search(name):
            return F.when(cell.isNotNull(), F.lit("[redacted]")).alias(name)
        return (F.substring(cell, 1, shown) if kinds[name] == "string" else cell).alias(name)

    return df.select(*[one(c) for c in df.columns])


def redact_map(c: Column, shown: int = 200) -> Column:
    return F.transform_values(c, lambda k, v: F.when(k.rlike("(?i)" + SENSITIVE_NAMES), "[redacted]")
                              .otherwise(F.substring(v, 1, shown)))


def pick_field(record: Column, candidates: tuple[str, ...]) -> Column:
    """First present candidate in a record map, ignoring case and blanks around the keys."""
    folded = F.transform_keys(record, lambda k, _: F.lower(P.trim_all(k)))
    return F.coalesce(*[F.when(P.trim_all(folded[name.lower()]) != "", folded[name.lower()]) for name in candidates])


def split_label(df: DataFrame, key: str, label: str = schema.LABEL_COLUMN) -> tuple[DataFrame, DataFrame | None]:
    """Features without the label, and (key, label) to join back only for scoring."""
    if label not in df.columns:
        return df, None
    return df.drop(label), df.select(key, F.col(f"`{label}`").alias("label"))

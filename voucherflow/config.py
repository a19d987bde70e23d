"""Rule settings: currency, rates, tolerances, category groups and size limits."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from decimal import Decimal

from voucherflow import schema


@dataclass(frozen=True)
class Rules:
    base_currency: str = "INR"
    valid_rates: tuple[Decimal, ...] = tuple(Decimal(r) for r in schema.RATE_SLABS)
    tax_tolerance: Decimal = Decimal("1.00")
    rate_match_tolerance: Decimal = Decimal("0.25")
    verify_gstin_checksum: bool = True
    ambiguous_score_threshold: float = 0.50
    ambiguous_margin_threshold: float = 0.15
    outward: tuple[str, ...] = ("Sales", "Export")
    inward: tuple[str, ...] = ("Purchase", "Import")
    credit_notes: tuple[str, ...] = ("Sales Return / Credit Note",)
    debit_notes: tuple[str, ...] = ("Purchase Return / Debit Note",)
    receipts: tuple[str, ...] = ("Receipt",)
    payments: tuple[str, ...] = ("Payment",)
    expenses: tuple[str, ...] = ("Expense",)
    itc_categories: tuple[str, ...] = ("Purchase", "Import", "Expense")

    def groups(self) -> dict[str, tuple[str, ...]]:
        """Category lists by group, in the order a category is looked up."""
        return {name: getattr(self, name) for name in schema.GROUPS}


# How each overridable key is read from JSON.
_CASTS = {
    "base_currency": lambda v: str(v).upper(),
    "valid_rates": lambda v: tuple(Decimal(str(r)) for r in v),
    "tax_tolerance": lambda v: Decimal(str(v)),
    "rate_match_tolerance": lambda v: Decimal(str(v)),
    "verify_gstin_checksum": bool,
    "ambiguous_score_threshold": float,
    "ambiguous_margin_threshold": float,
}


def load_rules(path: str | None = None) -> Rules:
    """Defaults, overridden by any known keys of a small JSON file; other keys are ignored."""
    if not path:
        return Rules()
    with open(path, encoding="utf-8") as handle:
        given = json.load(handle)
    known = {f.name for f in fields(Rules)}
    return replace(Rules(), **{k: _CASTS.get(k, tuple)(v) for k, v in given.items() if k in known})


@dataclass(frozen=True)
class Limits:
    """Optional size checks. All off (None) by default: Spark has no reason to refuse large inputs."""

    max_rows: int | None = None
    max_columns: int | None = None
    max_sheets: int | None = None
    max_bytes: int | None = None
    max_cell_chars: int | None = None

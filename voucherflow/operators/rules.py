"""Evidence rules as bit masks.

Each rule clause becomes one bit of a long computed once per row; conflicts,
families and identifier-only evidence are then plain bit arithmetic, so a row is
decided without arrays, lambdas or Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow.functions.parsing import all_of, any_of, clean_field
from voucherflow.operators.features import once, once_each

RULE_MATCH, REVIEW_REQUIRED, AMBIGUOUS, NO_RULE = "RULE_MATCH", "REVIEW_REQUIRED", "AMBIGUOUS", "NO_RULE"
UNCLASSIFIED = "Unclassified"

# ---- Fixed values: the rule table. ----
# One line per clause: rule | category | own-number prefix | referenced-number prefix | all of | any of | none of.
# Fields inside a cell are separated by ';', alternative groups of "any of" by '&'.
REJECTION = "Item Rejected;Quantity Rejected;Rejection Reason"
RETURN = "Units Returned;Reason for Return"
RULE_TABLE = f"""
R01|Rejection In|Rejection Note No=RJN-IN||||
R01|Rejection In||||{REJECTION}&GRN Reference;Receiving Company|
R02|Rejection Out|Rejection Note No=RJN-OUT||||
R02|Rejection Out||||{REJECTION}&DN Reference;Customer|
R03|Purchase Return / Debit Note|Document Number=DBN||||
R03|Purchase Return / Debit Note||Original Doc Ref=PUR||{RETURN}|
R04|Sales Return / Credit Note|Document Number=CRN||||
R04|Sales Return / Credit Note||Original Invoice Ref=SAL||{RETURN}|
R05|Purchase|Document Number=PUR-||||{RETURN}
R05|Purchase||PO Ref=PO|Vendor Name||{RETURN}
R06|Sales|Document Number=SAL-||||{RETURN}
R06|Sales||Delivery Ref=DN|Product||{RETURN}
R07|Purchase Order|PO Number=PO|||Quantity Required;Supplier;Promised Delivery|
R08|Sales Order|SO Number=SO|||Quantity Ordered;Selling Company;Customer|
R09|Delivery Note|Delivery Challan No=DC||||
R09|Delivery Note|||Item Dispatched;Quantity Shipped||
R10|Receipt Note|GRN Number=GRN||||
R10|Receipt Note|||Item Received;Quantity Received||Outward Job Work No
R11|Contra|Contra ID=CTR||||
R11|Contra|||Source Account;Destination Account;Transfer Amount||
R12|Payment|Payment ID=PMT||||
R12|Payment|||Payment Amount|Payer Organization;Payee Organization|
R13|Receipt|Receipt ID=RCP||||
R13|Receipt|||Received Amount|Receipt Nature;Receiving Organization|
R14|Salary / Payroll|Employee Code=EMP||||
R14|Salary / Payroll|||Gross Salary;Net Payable;Payroll Period||
R15|Expense|Expense Claim No=EXP|||Expense Type;Amount Claimed|
R16|Export|Export Invoice No=EXP|||Destination Country;Units Exported;Free on Board Value|
R17|Import|Import Bill No=IBL||||
R17|Import|||Originating Country|Units Imported;Customs Duty|
R18|Journal|Journal ID=JNL||||
R18|Journal|||Debit Side;Credit Side;Journal Type||
R19|Stock Journal|Stock Adj ID=SA||||
R19|Stock Journal|||Adjustment Qty;Storage Facility||
R20|Physical Stock|Stock Count ID=SC||||
R20|Physical Stock|||Book Quantity;Counted Quantity||
R21|Job Work In Order|JWIO Ref=JWIO||||
R21|Job Work In Order|||Processing Rate;Processor||Service Charge
R22|Job Work Out Order|JWOO Ref=JWOO||||
R22|Job Work Out Order|||Service Charge;Agreement Terms||
R23|Material In|Inward Job Work No=MIW||||
R23|Material In|||Subcontractor;Quantity Sent;Date of Dispatch||
R24|Material Out|Outward Job Work No=MOW||||
R24|Material Out|||Contractor;Quantity Received;Date of Receipt||
"""
# The earlier first-match engine also wanted these empty for the second Rejection In clause.
FIRST_MATCH_GUARD = ("Customer", "DN Reference")
# Details that show a family of vouchers without its direction.
FAMILIES = (
    ("Return", tuple(RETURN.split(";")), ("Purchase Return / Debit Note", "Sales Return / Credit Note")),
    ("Rejection", tuple(REJECTION.split(";")), ("Rejection In", "Rejection Out")),
)
# ---- End of fixed values. ----


@dataclass(frozen=True)
class Clause:
    bit: int
    rule: str
    category: str
    own: tuple[str, str] | None
    reference: tuple[str, str] | None
    every: tuple[str, ...]
    some: tuple[tuple[str, ...], ...]
    none: tuple[str, ...] = field(default=())

    @property
    def basis(self) -> str:
        backed = bool(self.every or self.some)
        if self.own:
            return "identifier+fields" if backed else "identifier"
        return "reference+fields" if self.reference else "fields"

    @property
    def kind(self) -> str:
        """Wording of the clause kind in rule traces."""
        if self.own:
            return "own-ID prefix" + (" + field presence" if self.every or self.some else "")
        return "reference-ID prefix + field presence" if self.reference else "field presence only"

    def fields(self) -> list[str]:
        named = [p[0] for p in (self.own, self.reference) if p]
        return named + list(self.every) + [f for group in self.some for f in group]


def _split(text: str, sep: str = ";") -> tuple[str, ...]:
    return tuple(p for p in text.split(sep) if p)


def _pair(text: str) -> tuple[str, str] | None:
    return tuple(text.split("=")) if text else None  # type: ignore[return-value]


def _read_table() -> tuple[Clause, ...]:
    out = []
    for bit, line in enumerate(RULE_TABLE.strip().splitlines()):
        rule, category, own, reference, every, some, none = line.split("|")
        out.append(Clause(bit, rule, category, _pair(own), _pair(reference), _split(every),
                          tuple(_split(g) for g in _split(some, "&")), _split(none)))
    return tuple(out)


CLAUSES = _read_table()
GUARDED_BIT = len(CLAUSES)      # Rejection In by fields, under the first-match guard
RULE_IDS = tuple(dict.fromkeys(c.rule for c in CLAUSES))
CATEGORY = {c.rule: c.category for c in CLAUSES}
USED_FIELDS = tuple(dict.fromkeys(
    [f for c in CLAUSES for f in (*c.fields(), *c.none)] + [f for _, names, _ in FAMILIES for f in names]))


def mask_of(test) -> int:
    return sum(1 << c.bit for c in CLAUSES if test(c))


IDENTIFIER_MASK = mask_of(lambda c: c.basis == "identifier")
RULE_MASK = {rid: mask_of(lambda c, rid=rid: c.rule == rid) for rid in RULE_IDS}
ALL_MASK = mask_of(lambda c: True)
# Clause kinds switched off in ablation runs.
MODES = {"all": 0, "no_own_prefix": mask_of(lambda c: c.own is not None),
         "presence_only": mask_of(lambda c: c.own is not None or c.reference is not None)}


def field_columns(df: DataFrame, names=USED_FIELDS) -> dict[str, Column]:
    """Cleaned value of every rule field; a column the input lacks reads as empty."""
    have = set(df.columns)
    return {n: clean_field(F.col(f"`{n}`")) if n in have else F.lit("") for n in names}


WORD = 60               # fields whose presence one long holds
AT_ONCE = 8             # fields cleaned, or clauses tested, in one step
PREFIXES = tuple(dict.fromkeys(p for c in CLAUSES for p in (c.own, c.reference) if p))
WORDS = range(-(-len(USED_FIELDS) // WORD))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _sum_bits(tests: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, _long(1 << bit)).otherwise(_long(0)) for t, bit in tests], _long(0))


def _field_bits(df: DataFrame, values: dict[str, Column], prefix: str) -> DataFrame:
    """Add `{prefix}__filled0`, … (one bit per field with a value) and `{prefix}__starts` (one bit per number prefix that is met) of some fields."""
    parts: dict[str, list[str]] = {f"{prefix}__filled{w}": [] for w in WORDS} | {f"{prefix}__starts": []}
    names = list(values)
    for start in range(0, len(names), AT_ONCE):
        here = names[start:start + AT_ONCE]
        df = once(df, {f"__x{i}": values[n] for i, n in enumerate(here)})
        made = {}
        for total, tests in [*((f"{prefix}__filled{w}", [(F.col(f"__x{i}") != "", at % WORD) for i, n in enumerate(here)
                                                        if (at := USED_FIELDS.index(n)) // WORD == w]) for w in WORDS),
                             (f"{prefix}__starts", [(F.col(f"__x{here.index(f)}").startswith(text), bit)
                                                    for bit, (f, text) in enumerate(PREFIXES) if f in here])]:
            if tests:
                parts[total].append(f"{total}_{start}")
                made[parts[total][-1]] = _sum_bits(tests)
        df = once(df, made).drop(*[f"__x{i}" for i in range(len(here))])
    sums = {total: reduce(lambda a, b: a + b, [F.col(n) for n in found], _long(0)) for total, found in parts.items()}
    return once(df, sums).drop(*[n for found in parts.values() for n in found])


def _masks(names) -> list[tuple[int, int]]:
    """(word, mask) of some fields."""
    at = [USED_FIELDS.index(n) for n in dict.fromkeys(names)]
    return [(w, m) for w in WORDS if (m := sum(1 << a % WORD for a in at if a // WORD == w))]


def clause_test(clause: Clause, prefix: str = "") -> Column:
    """Whether a clause holds, from the bits of `_field_bits`."""
    held = lambda w, m: F.col(f"{prefix}__filled{w}").bitwiseAND(_long(m))
    tests = [F.col(f"{prefix}__starts").bitwiseAND(_long(1 << PREFIXES.index(p))) != 0 for p in (clause.own, clause.reference) if p]
    tests += [held(w, m) == _long(m) for w, m in _masks(clause.every)]
    tests += [any_of([held(w, m) != 0 for w, m in _masks(group)]) for group in clause.some]
    tests += [held(w, m) == 0 for w, m in _masks(clause.none)]
    return all_of(tests)


def with_evidence(df: DataFrame, prefix: str = "", change: dict[str, Column] | None = None, base: str | None = None) -> DataFrame:
    """Add `clause_bits` (one bit per satisfied clause) and `family_bits` (families whose details are present).

    `change` replaces the cleaned value of some fields, so several treatments of the
    same row can be judged side by side under different prefixes. Fields become bits a few
    at a time, and clauses are tests of those bits. With `base`, the prefix of `with_field_bits` of the
    same rows, only the changed fields are read again.
    """
    change = change or {}
    if base is None:
        have = set(df.columns)
        values = {n: change.get(n, clean_field(F.col(f"`{n}`")) if n in have else None) for n in USED_FIELDS}
        df = _field_bits(df, {n: v for n, v in values.items() if v is not None}, prefix)
    else:
        df = _field_bits(df, {n: v for n, v in change.items() if n in USED_FIELDS}, prefix)
        kept = dict(_masks([n for n in USED_FIELDS if n not in change]))
        starts = sum(1 << bit for bit, (f, _) in enumerate(PREFIXES) if f not in change)
        wanted = {f"{prefix}__filled{w}": kept.get(w, 0) for w in WORDS} | {f"{prefix}__starts": starts}
        df = once(df.withColumnsRenamed({n: f"__new{i}" for i, n in enumerate(wanted)}),
                  {n: F.col(f"__new{i}").bitwiseOR(F.col(base + n[len(prefix):]).bitwiseAND(_long(m))) for i, (n, m) in enumerate(wanted.items())}) \
            .drop(*[f"__new{i}" for i in range(len(wanted))])
    guarded = clause_test(CLAUSES[1], prefix) & all_of([F.col(f"{prefix}__filled{w}").bitwiseAND(_long(m)) == 0 for w, m in _masks(FIRST_MATCH_GUARD)])
    tests = [(clause_test(c, prefix), c.bit) for c in CLAUSES] + [(guarded, GUARDED_BIT)]
    size = 2 * AT_ONCE
    parts = {f"__c{start}": _sum_bits(tests[start:start + size]) for start in range(0, len(tests), size)}
    families = [F.when(any_of([F.col(f"{prefix}__filled{w}").bitwiseAND(_long(m)) != 0 for w, m in _masks(names)]), 1 << i).otherwise(0)
                for i, (_, names, _) in enumerate(FAMILIES)]
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    out = once_each(df, parts, 1)
    return once(out, {f"{prefix}clause_bits": add([F.col(n) for n in parts]), f"{prefix}family_bits": add(families)}) \
        .drop(*parts, *[f"{prefix}__filled{w}" for w in WORDS], f"{prefix}__starts")


def with_field_bits(df: DataFrame, prefix: str) -> DataFrame:
    """The bits of all rule fields under a prefix, for `with_evidence(…, base=prefix)`."""
    have = set(df.columns)
    return _field_bits(df, {n: clean_field(F.col(f"`{n}`")) for n in USED_FIELDS if n in have}, prefix)


def has_any(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def rule_bits(bits: Column) -> Column:
    """One bit per rule that has evidence, in rule order."""
    return reduce(lambda a, b: a + b, [
        F.when(has_any(bits, RULE_MASK[r]), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULE_IDS)])


def category_names(bits: Column, separator: str = " | ") -> Column:
    """Categories of a rule mask in rule order."""
    return F.concat_ws(separator, *[
        F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, CATEGORY[r]) for i, r in enumerate(RULE_IDS)])


def first_category(bits: Column) -> Column:
    """Category of the lowest set bit of a rule mask."""
    return F.coalesce(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, CATEGORY[r]) for i, r in enumerate(RULE_IDS)])


def decide(df: DataFrame) -> DataFrame:
    """Rule status, category (only on RULE_MATCH) and candidates of every row."""
    df = df if "clause_bits" in df.columns else with_evidence(df)
    c = F.col
    df = once(df, {"rule_bits": rule_bits(c("clause_bits").bitwiseAND(F.lit(ALL_MASK).cast("bigint")))})
    index = {CATEGORY[r]: i for i, r in enumerate(RULE_IDS)}
    n = F.bit_count("rule_bits")
    undirected = None          # first family with details but no candidate among its members
    for i, (name, _, members) in enumerate(FAMILIES):
        member_mask = sum(1 << index[m] for m in members)
        here = (c("family_bits").bitwiseAND(F.lit(1 << i)) != 0) & (c("rule_bits").bitwiseAND(F.lit(member_mask)) == 0)
        undirected = F.when(here, name) if undirected is None else undirected.when(here, name)
    df = once(df, {"undirected": undirected})
    only_ids = c("clause_bits").bitwiseAND(F.lit(ALL_MASK & ~IDENTIFIER_MASK).cast("bigint")) == 0
    status = F.when(n > 1, REVIEW_REQUIRED) \
        .when(c("undirected").isNotNull(), F.when(n > 0, REVIEW_REQUIRED).otherwise(AMBIGUOUS)) \
        .when(n == 0, NO_RULE).when(only_ids, AMBIGUOUS).otherwise(RULE_MATCH)
    members = F.when(c("undirected") == FAMILIES[0][0], " | ".join(FAMILIES[0][2])) \
        .when(c("undirected") == FAMILIES[1][0], " | ".join(FAMILIES[1][2]))
    df = once(df, {"__n": category_names(c("rule_bits"))})
    named = F.nullif(c("__n"), F.lit(""))
    candidates = F.when(n > 1, named).otherwise(F.concat_ws(" | ", named, members))
    df = once(df, {"rule_status": status, "rule_candidates": candidates}).drop("__n")
    return df.withColumn("rule_category", F.when(c("rule_status") == RULE_MATCH, c("rule_candidates")))


def with_model_fallback(df: DataFrame, model: str = "model_prediction") -> DataFrame:
    """The rule decides only on RULE_MATCH; otherwise the model prediction stands."""
    return df.withColumn("prediction", F.coalesce("rule_category", F.nullif(F.col(model), F.lit("")), F.lit(UNCLASSIFIED)))


def masked_bits(mode: str = "all", guarded: bool = True, prefix: str = "") -> Column:
    """Clause bits of the first-match engine with the mode's prefix clauses switched off."""
    off = MODES[mode]
    held = F.col(f"{prefix}clause_bits")
    bits = held.bitwiseAND(F.lit(ALL_MASK & ~off).cast("bigint"))
    if guarded:
        plain = F.lit(~(1 << 1) & ALL_MASK).cast("bigint")
        again = F.when(has_any(held, 1 << GUARDED_BIT), F.lit(2).cast("bigint")) \
            .otherwise(F.lit(0).cast("bigint"))
        bits = bits.bitwiseAND(plain).bitwiseOR(again)
    return bits


def first_match(df: DataFrame, out: str = "first_match", mode: str = "all", prefix: str = "") -> DataFrame:
    """Category of the first rule in table order that holds (null when none does)."""
    df = df if f"{prefix}clause_bits" in df.columns else with_evidence(df, prefix)
    return once(once(df, {"__r": rule_bits(masked_bits(mode, prefix=prefix))}), {out: first_category(F.col("__r"))}).drop("__r")


def with_descriptions(df: DataFrame) -> DataFrame:
    """Add `evidence_text`: 'Category [rule, basis: field=value, …]' for every satisfied clause, '; ' between them.

    Built a few clauses at a time so that each step compiles to a method of its own.
    """
    values, out, names = field_columns(df), df, []
    for start in range(0, len(CLAUSES), 4):
        group = CLAUSES[start:start + 4]
        fields = list(dict.fromkeys(f for c in group for f in c.fields()))
        out, value = _cleaned(out, values, fields)
        parts = []
        for c in group:
            pairs = F.concat_ws(", ", *[F.when(value[f] != "", F.concat(F.lit(f"{f}="), value[f])) for f in c.fields()])
            parts.append(F.when(has_any(F.col("clause_bits"), 1 << c.bit),
                                F.concat(F.lit(f"{c.category} [{c.rule}, {c.basis}: "), pairs, F.lit("]"))))
        names.append(f"__t{start}")
        out = once(out, {names[-1]: F.nullif(F.concat_ws("; ", *parts), F.lit(""))}).drop(*[f"__x{i}" for i in range(len(fields))])
    for n, (_, fields, _) in enumerate(FAMILIES):
        out, value = _cleaned(out, values, list(fields))
        out = once(out, {f"__f{n}": F.concat_ws(", ", *[F.when(value[f] != "", f) for f in fields])}).drop(*[f"__x{i}" for i in range(len(fields))])
    return once(out, {"evidence_text": F.concat_ws("; ", *names)}).drop(*names)


def _cleaned(df: DataFrame, values: dict[str, Column], fields: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Some cleaned fields as `__x0`, `__x1`, …, and the column of each."""
    return once_each(df, {f"__x{i}": values[f] for i, f in enumerate(fields)}, AT_ONCE), {f: F.col(f"__x{i}") for i, f in enumerate(fields)}


def explain(df: DataFrame) -> DataFrame:
    """Sentence behind each decision."""
    c = F.col
    df = once(with_descriptions(df), {"__n": category_names(c("rule_bits"))})
    out = F.when(F.bit_count("rule_bits") > 1, F.concat(
        F.lit("Conflicting evidence for "), F.replace(c("__n"), F.lit(" | "), F.lit(" vs ")), F.lit(": "), c("evidence_text")))
    for i, (name, _, members) in enumerate(FAMILIES):
        here, opening = c("undirected") == name, F.concat(F.lit(f"{name} details ("), c(f"__f{i}"))
        out = out.when(here & (c("rule_bits") != 0), F.concat(
            opening, F.lit(") contradict "), c("__n"), F.lit(" evidence: "), c("evidence_text")))
        out = out.when(here, F.concat(opening, F.lit(") without direction evidence: " + " or ".join(members))))
    out = out.when(c("rule_status") == NO_RULE, "No rule evidence") \
        .when(c("rule_status") == AMBIGUOUS, F.concat(
            F.lit("Identifier prefix only, no supporting transaction fields: "), c("evidence_text"))) \
        .otherwise(F.concat(F.lit("Consistent evidence for "), c("evidence_text")))
    return once(df, {"explanation": out}).drop("__f0", "__f1", "__n")


def evidence_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per satisfied clause: rule, category, basis."""
    df = df if "clause_bits" in df.columns else with_evidence(df)
    hits = F.array(*[F.when(has_any(F.col("clause_bits"), 1 << c.bit), F.struct(
        F.lit(c.rule).alias("rule_id"), F.lit(c.category).alias("category"), F.lit(c.basis).alias("basis"),
        F.lit(c.bit).alias("clause"))) for c in CLAUSES])
    return df.select(key, F.explode(hits).alias("e")).filter("e IS NOT NULL").select(key, "e.*")


LOW_SCORE = 0.60   # fixed value: model scores below this are sent to review


def decision_columns(df: DataFrame, score: str = "model_score", model: str = "model_prediction") -> DataFrame:
    """The ten decision columns written next to every classified row."""
    c = F.col
    df = explain(with_model_fallback(df, model))
    source = F.when(c("rule_status") == RULE_MATCH, "RULE").otherwise("MODEL")
    reason = F.when(c("rule_status") == REVIEW_REQUIRED, "Conflicting rule evidence") \
        .when(c("rule_status") == AMBIGUOUS, "Insufficient rule evidence") \
        .when((source == "MODEL") & c(score).isNull(), "No model score") \
        .when((source == "MODEL") & (c(score) < LOW_SCORE), f"Model score below {LOW_SCORE:.2f} (uncalibrated)") \
        .otherwise("")
    return df.withColumns({
        "decision_source": source, "review_reason": reason, "review_required": reason != "",
        "rule_overrode_model": (source == "RULE") & (c("prediction") != c(model)),
        "model_score_shown": F.round(score, 4),
        "prediction_explanation": F.when(c("rule_status") == NO_RULE, "No rule evidence; model statistical prediction")
        .otherwise(c("explanation"))})

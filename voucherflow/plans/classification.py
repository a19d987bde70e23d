"""Queries over wide vouchers: evidence rules, first-match rules, corrections and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.operators import correction as C
from voucherflow.operators import normalize as N
from voucherflow.operators import rules as R
from voucherflow.plans.ctes import category_sql, cte, lit, lits, sql_list, with_
from voucherflow.plans.registry import query
from voucherflow.session import ensure_checkpoint_dir
from voucherflow.sources import readers
from voucherflow.sources import tables as T
from voucherflow.sources.wide import WIDE_COLUMNS, wide_sql, wide_vouchers

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def trim_sql(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def field_sql(name: str) -> str:
    x = trim_sql(f'"{name}"')
    return f"coalesce(CASE WHEN lower({x}) NOT IN ('nan', 'none', 'nat') THEN {x} END, '')"


def _fields_select() -> str:
    return ", ".join((field_sql(n) if n in WIDE_COLUMNS else "''") + f' AS "{n}"' for n in R.USED_FIELDS)


def _clause_sql(c: R.Clause) -> str:
    tests = [f'starts_with("{f}", {lit(p)})' for f, p in (x for x in (c.own, c.reference) if x)]
    tests += [f"\"{f}\" <> ''" for f in c.every]
    tests += ["(" + " OR ".join(f"\"{f}\" <> ''" for f in g) + ")" for g in c.some]
    tests += [f"\"{f}\" = ''" for f in c.none]
    return " AND ".join(tests)


cte("wide", (), wide_sql())
cte("wide_clean", ("wide",), f'SELECT ord, source_ref, "{schema.LABEL_COLUMN}" AS label, {_fields_select()} FROM wide')
cte("evidence", ("wide_clean",), "SELECT *, " + ", ".join(
    f"({_clause_sql(c)}) AS c{c.bit}" for c in R.CLAUSES)
    + f", ({_clause_sql(R.CLAUSES[1])} AND \"Customer\" = '' AND \"DN Reference\" = '') AS c{R.GUARDED_BIT}, "
    + ", ".join("(" + " OR ".join(f"\"{f}\" <> ''" for f in names) + f") AS fam{i}" for i, (_, names, _) in enumerate(R.FAMILIES))
    + " FROM wide_clean")


def _cats_sql(disabled=lambda c: False, guarded=False) -> str:
    arms = []
    for rid in R.RULE_IDS:
        own = [c for c in R.CLAUSES if c.rule == rid and not disabled(c)]
        tests = [f"c{R.GUARDED_BIT if guarded and c.bit == 1 else c.bit}" for c in own]
        if tests:
            arms.append(f"CASE WHEN {' OR '.join(tests)} THEN {lit(R.CATEGORY[rid])} END")
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


_ONLY_IDS = "NOT (" + " OR ".join(f"c{c.bit}" for c in R.CLAUSES if c.basis != "identifier") + ")"
_UNDIRECTED = " ".join(f"WHEN fam{i} AND NOT list_has_any(cats, {sql_list(members)}) THEN {i + 1}"
                       for i, (_, _, members) in enumerate(R.FAMILIES))
cte("decided0", ("evidence",), f"SELECT *, {_cats_sql()} AS cats FROM evidence")
cte("decided1", ("decided0",), f"SELECT *, CASE {_UNDIRECTED} ELSE 0 END AS fam FROM decided0")
cte("decided", ("decided1",), f"""
SELECT *, CASE WHEN len(cats) > 1 THEN 'REVIEW_REQUIRED' WHEN fam > 0 THEN CASE WHEN len(cats) > 0 THEN 'REVIEW_REQUIRED' ELSE 'AMBIGUOUS' END
 WHEN len(cats) = 0 THEN 'NO_RULE' WHEN {_ONLY_IDS} THEN 'AMBIGUOUS' ELSE 'RULE_MATCH' END AS rule_status,
 array_to_string(CASE WHEN len(cats) > 1 OR fam = 0 THEN cats ELSE list_concat(cats, CASE fam WHEN 1 THEN {sql_list(R.FAMILIES[0][2])}
  ELSE {sql_list(R.FAMILIES[1][2])} END) END, ' | ') AS rule_candidates FROM decided1""")


def decided(spark, sf):
    return R.decide(R.with_evidence(wide_vouchers(spark, sf)))


@query("derived_wide", with_("wide", "SELECT source_ref, " + ", ".join(f'"{c}"' for c in (*WIDE_COLUMNS, schema.LABEL_COLUMN)) + " FROM wide"))
def derived_wide(spark, sf):
    return wide_vouchers(spark, sf).drop("ord")


cte("clause_hits", ("evidence",), " UNION ALL ".join(
    f"SELECT source_ref, '{c.rule}' AS rule_id, {lit(c.category)} AS category, '{c.basis}' AS basis, {c.bit} AS clause FROM evidence WHERE c{c.bit}"
    for c in R.CLAUSES))


@query("cls_01", with_("clause_hits", "SELECT clause, basis, count(*) AS n_rows FROM clause_hits GROUP BY ALL"))
def cls_01(spark, sf):
    return R.evidence_rows(wide_vouchers(spark, sf), "source_ref").groupBy("clause", "basis").agg(F.count(F.lit(1)).alias("n_rows"))


@query("cls_02", with_("clause_hits", "SELECT rule_id, category, count(DISTINCT source_ref) AS n_rows FROM clause_hits GROUP BY ALL"))
def cls_02(spark, sf):
    rows = R.evidence_rows(wide_vouchers(spark, sf), "source_ref").select("source_ref", "rule_id", "category").distinct()
    return rows.groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n_rows"))


@query("cls_03", with_("clause_hits", "SELECT source_ref, rule_id, category, basis, clause FROM clause_hits"))
def cls_03(spark, sf):
    return R.evidence_rows(wide_vouchers(spark, sf), "source_ref").select("source_ref", "rule_id", "category", "basis", "clause")


@query("cls_04", with_("decided", """
SELECT source_ref, rule_status, rule_candidates, CASE WHEN rule_status = 'RULE_MATCH' THEN rule_candidates END AS rule_category FROM decided"""))
def cls_04(spark, sf):
    return decided(spark, sf).select("source_ref", "rule_status", "rule_candidates", "rule_category")


@query("src_05", with_("decided", "SELECT ord AS voucher_key, rule_status, CASE WHEN rule_status = 'RULE_MATCH' THEN rule_candidates END AS rule_category FROM decided"))
def src_05(spark, sf):
    """Batch scoring of a table that is read from CSV files: the vouchers written out, read back as sheets and decided."""
    wide = wide_vouchers(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batch-{uuid.uuid4().hex}"
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns if c not in N.PROVENANCE]
    wide.select(F.col("ord").cast("string").alias("Voucher Key"), *cells).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    read = readers.read_sheets(spark, [(folder, "csv")])
    return R.decide(R.with_evidence(read)).select(F.col("`Voucher Key`").cast("bigint").alias("voucher_key"), "rule_status", "rule_category")


def _with_model(df):
    """A stand-in model: the category of the row's own slot, shifted on some rows, with a score."""
    return df.withColumns({
        "model_prediction": T.category_at(F.col("ord") + F.when(F.col("ord") % 9 == 0, 1).otherwise(0)),
        "model_score": F.when(F.col("ord") % 10 != 0, (F.col("ord") % 100).cast("double") / 100)})


_MODEL_SQL = (f"{category_sql('ord + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END')} AS model_prediction, "
              "CASE WHEN ord % 10 <> 0 THEN CAST(ord % 100 AS DOUBLE) / 100 END AS model_score")
cte("modelled", ("decided",), f"""
SELECT *, CASE WHEN rule_status = 'RULE_MATCH' THEN rule_candidates ELSE coalesce(model_prediction, 'Unclassified') END AS prediction
FROM (SELECT *, {_MODEL_SQL} FROM decided)""")


@query("cls_05", with_("modelled", "SELECT source_ref, rule_status, model_prediction, prediction FROM modelled"))
def cls_05(spark, sf):
    return R.with_model_fallback(_with_model(decided(spark, sf))).select("source_ref", "rule_status", "model_prediction", "prediction")


def _first_sql(mode):
    off = {"all": lambda c: False, "no_own_prefix": lambda c: c.own is not None,
           "presence_only": lambda c: c.own is not None or c.reference is not None}[mode]
    return f"({_cats_sql(off, True)})[1]"


@query("cls_06", with_("evidence", f"SELECT source_ref, {_first_sql('all')} AS first_match FROM evidence"))
def cls_06(spark, sf):
    return R.first_match(wide_vouchers(spark, sf)).select("source_ref", "first_match")


@query("cls_16", with_("evidence", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, source_ref, {_first_sql(m)} AS first_match FROM evidence" for m in R.MODES)))
def cls_16(spark, sf):
    rows = R.with_evidence(wide_vouchers(spark, sf))
    for mode in R.MODES:
        rows = R.first_match(rows, f"m_{mode}", mode)
    return rows.select("source_ref", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mode"), F.col(f"m_{m}").alias("first_match")) for m in R.MODES])).alias("e")).select(
        "e.mode", "source_ref", "e.first_match")


@query("cls_17", with_("modelled", f"SELECT source_ref, coalesce({_first_sql('presence_only')}, model_prediction, 'Unclassified') AS combined FROM modelled"))
def cls_17(spark, sf):
    rows = R.first_match(_with_model(R.with_evidence(wide_vouchers(spark, sf))), "rule_prediction", "presence_only")
    return rows.select("source_ref", F.coalesce("rule_prediction", "model_prediction", F.lit(R.UNCLASSIFIED)).alias("combined"))


def _describe_sql() -> str:
    parts = []
    for c in R.CLAUSES:
        pairs = ", ".join(f"CASE WHEN \"{f}\" <> '' THEN '{f}=' || \"{f}\" END" for f in c.fields())
        parts.append(f"CASE WHEN c{c.bit} THEN {lit(f'{c.category} [{c.rule}, {c.basis}: ')} || concat_ws(', ', {pairs}) || ']' END")
    return f"concat_ws('; ', {', '.join(parts)})"


def _shown(i):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN \"{f}\" <> '' THEN '{f}' END" for f in R.FAMILIES[i][1]) + ")"


def _explain_sql() -> str:
    d = _describe_sql()
    fam = " ".join(
        f"WHEN fam = {i + 1} AND len(cats) > 0 THEN '{n} details (' || {_shown(i)} || ') contradict ' || cats[1] || ' evidence: ' || ev "
        f"WHEN fam = {i + 1} THEN '{n} details (' || {_shown(i)} || {lit(') without direction evidence: ' + ' or '.join(m))}"
        for i, (n, _, m) in enumerate(R.FAMILIES))
    return (f"SELECT *, CASE WHEN len(cats) > 1 THEN 'Conflicting evidence for ' || array_to_string(cats, ' vs ') || ': ' || ev {fam} "
            f"WHEN rule_status = 'NO_RULE' THEN 'No rule evidence' WHEN rule_status = 'AMBIGUOUS' THEN "
            f"'Identifier prefix only, no supporting transaction fields: ' || ev ELSE 'Consistent evidence for ' || ev END AS explanation "
            f"FROM (SELECT *, {d} AS ev FROM modelled)")


cte("explained", ("modelled",), _explain_sql())
_SRC = "CASE WHEN rule_status = 'RULE_MATCH' THEN 'RULE' ELSE 'MODEL' END"
cte("decision", ("explained",), f"""
SELECT *, review_reason <> '' AS review_required FROM (SELECT *, {_SRC} AS decision_source,
 CASE WHEN rule_status = 'REVIEW_REQUIRED' THEN 'Conflicting rule evidence' WHEN rule_status = 'AMBIGUOUS' THEN 'Insufficient rule evidence'
  WHEN {_SRC} = 'MODEL' AND model_score IS NULL THEN 'No model score' WHEN {_SRC} = 'MODEL' AND model_score < 0.60
  THEN 'Model score below 0.60 (uncalibrated)' ELSE '' END AS review_reason,
 {_SRC} = 'RULE' AND prediction <> model_prediction AS rule_overrode_model,
 CASE WHEN rule_status = 'NO_RULE' THEN 'No rule evidence; model statistical prediction' ELSE explanation END AS prediction_explanation FROM explained)""")
_DECISION = ("source_ref", "prediction", "decision_source", "rule_status", "rule_candidates", "model_prediction",
             "model_score", "rule_overrode_model", "review_required", "review_reason", "prediction_explanation")


@query("cls_14", with_("decision", f"SELECT {', '.join(_DECISION)} FROM decision"))
def cls_14(spark, sf):
    return R.decision_columns(_with_model(decided(spark, sf))).select(*_DECISION)


@query("cls_15", with_("modelled", """
SELECT prediction, prediction IN ('Other / Miscellaneous') AS review_route, count(*) AS n_rows FROM modelled GROUP BY ALL"""))
def cls_15(spark, sf):
    rows = R.with_model_fallback(_with_model(decided(spark, sf)))
    return rows.groupBy("prediction", F.col("prediction").isin(*REVIEW_ROUTE).alias("review_route")).agg(F.count(F.lit(1)).alias("n_rows"))


REVIEW_ROUTE = ("Other / Miscellaneous",)   # fixed value: labels that are always reviewed

# ---------------------------------------------------------------- corrections over canonical rows
_DOC_TYPES = ("sales order", "Purchase Order Form", "credit note", "delivery note", "", "advice", "Tax  Invoice", "memo")
_ITEMS = ("Advance against supply", "steel rods", "prepaid card", "goods returned to supplier", "cloth", "freight charges", "office rent")
_NARRS = ("advance paid to vendor", "credit note for customer", "debit note issued", "purchase invoice reversed", "monthly dealer sale",
          "bank transfer", "rebate adjustment", "sales return booked", "tea")
_STATUS = ("Prepaid", "Paid", "received in advance", "Due")


def canonical_rows(spark, sf):
    """Canonical text rows from orders, with words the correction rules react to."""
    o = T.spread(T.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"))
    k = F.col("k")
    return o.select(
        k.alias("ord"), T.pick(k % 8, _DOC_TYPES).alias("document_type"), T.pick(k % 7, _ITEMS).alias("item_description"),
        T.pick(k % 9, _NARRS).alias("transaction_narration"), T.pick(k % 4, _STATUS).alias("payment_status"),
        F.when(k % 3 == 0, "Cash / Bank").alias("debit_credit_info"),
        F.when(k % 5 == 0, F.concat(F.lit("Party "), F.col("cust").cast("string"), F.when(k % 2 == 0, " Ltd").otherwise(""))).alias("buyer_customer"),
        F.when(k % 5 == 1, F.concat(F.lit("Party "), F.col("cust").cast("string"))).alias("seller_supplier"),
        T.category_at(k).alias("prediction"))


def _pick(values, expr):
    return f"({sql_list(values)})[{expr} + 1]"


cte("canonical", (), f"""
SELECT o_orderkey AS ord, {_pick(_DOC_TYPES, 'o_orderkey % 8')} AS document_type, {_pick(_ITEMS, 'o_orderkey % 7')} AS item_description,
 {_pick(_NARRS, 'o_orderkey % 9')} AS transaction_narration, {_pick(_STATUS, 'o_orderkey % 4')} AS payment_status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Cash / Bank' END AS debit_credit_info,
 CASE WHEN o_orderkey % 5 = 0 THEN 'Party ' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' Ltd' ELSE '' END END AS buyer_customer,
 CASE WHEN o_orderkey % 5 = 1 THEN 'Party ' || CAST(o_custkey AS VARCHAR) END AS seller_supplier,
 {category_sql('o_orderkey')} AS prediction FROM orders""")


def _fold(x):
    return f"lower({trim_sql(f'''regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')''')})"


cte("canon_terms", ("canonical",), f"""
SELECT *, CAST(regexp_matches(item, {lit(C.ADVANCE_WORDS)}) AS INT) + CAST(regexp_matches(narr, {lit(C.ADVANCE_WORDS)}) AS INT)
 + CAST(regexp_matches(pstat, {lit(C.ADVANCE_STATUS)}) AS INT) AS signals,
 regexp_matches(said, {lit(C.SALES_NOTE)}) AS sn, regexp_matches(said, {lit(C.PURCHASE_NOTE)}) AS pn,
 regexp_matches(said, {lit(C.CUSTOMER_SIDE)}) OR {_fold('buyer_customer')} <> '' AS cs,
 regexp_matches(said, {lit(C.SUPPLIER_SIDE)}) OR {_fold('seller_supplier')} <> '' AS ss
FROM (SELECT *, item || ' ' || narr || ' ' || dci AS said FROM (SELECT *, {_fold('document_type')} AS dt, {_fold('item_description')} AS item,
 {_fold('transaction_narration')} AS narr, {_fold('payment_status')} AS pstat, {_fold('debit_credit_info')} AS dci FROM canonical))""")
_ORDERS_SQL = ("WHEN dt IN ('sales order', 'sales order form') THEN {so} WHEN dt IN ('purchase order', 'purchase order form') THEN {po}")


def _correct_sql(version):
    kept = lits(C.KEPT_TYPES + (C.KEPT_NOTES if version == 1 else ()))
    label = (f"CASE {_ORDERS_SQL.format(so=lit('Sales Order'), po=lit('Purchase Order'))} WHEN dt IN ({kept}) THEN prediction "
             f"WHEN signals >= 2 THEN 'Advance / Prepayment' ")
    adv = "'Advance evidence in ' || CAST(signals AS VARCHAR) || ' fields'" if version == 1 else "'Advance evidence in at least two fields'"
    reason = (f"CASE {_ORDERS_SQL.format(so=lit('Explicit document_type: sales order'), po=lit('Explicit document_type: purchase order'))} "
              f"WHEN dt IN ({kept}) THEN 'Preserved explicit non-order document type' WHEN signals >= 2 THEN {adv} ")
    if version == 2:
        label += "WHEN sn AND cs AND NOT pn THEN 'Sales Return / Credit Note' WHEN pn AND ss AND NOT sn THEN 'Purchase Return / Debit Note' "
        reason += ("WHEN sn AND cs AND NOT pn THEN 'Explicit sales credit-note evidence with customer-side context' "
                   "WHEN pn AND ss AND NOT sn THEN 'Explicit purchase debit-note evidence with supplier-side context' ")
    return (f"SELECT ord, prediction, {label} ELSE prediction END AS corrected, {reason} ELSE 'No correction rule matched' END AS correction_reason FROM canon_terms")


@query("cls_07", with_("canon_terms", _correct_sql(1)))
def cls_07(spark, sf):
    return C.correct(canonical_rows(spark, sf), version=1).select("ord", "prediction", "corrected", "correction_reason")


@query("cls_08", with_("canon_terms", _correct_sql(2)))
def cls_08(spark, sf):
    return C.correct(canonical_rows(spark, sf), version=2).select("ord", "prediction", "corrected", "correction_reason")


_DESC = "lower(item_description || ' ' || transaction_narration)"
_KW = " ".join(f"WHEN {'(' if n == 'Sales' else ''}regexp_matches({_DESC}, {lit(w)}){''' OR contains(lower(coalesce(buyer_customer, '')), 'ltd'))''' if n == 'Sales' else ''} THEN {{}}" for n, _, w in C.KEYWORDS)
_KW_LABEL = _KW.format(*[lit(n) for n, _, _ in C.KEYWORDS])
_KW_SCORE = _KW.format(*[str(p) for _, p, _ in C.KEYWORDS])


@query("cls_09", with_("canonical", f"""
SELECT ord, voucher, score, CASE WHEN score < 70 THEN 'Review' ELSE 'High' END AS status,
 voucher || ':' || CAST(score AS VARCHAR) || ',' || CASE WHEN voucher = 'Expense' THEN 'Purchase' ELSE 'Expense' END || ':' || CAST(greatest(5, 95 - score) AS VARCHAR) || ',Payment:5' AS candidates
FROM (SELECT ord, CASE {_KW_LABEL} ELSE 'Expense' END AS voucher, CASE {_KW_SCORE} ELSE 85 END AS score FROM canonical)"""))
def cls_09(spark, sf):
    rows = canonical_rows(spark, sf).withColumn("desc", F.concat_ws(" ", "item_description", "transaction_narration"))
    label, score, status = C.keyword_class(F.col("desc"), F.col("buyer_customer"))
    rows = rows.select("ord", label.alias("voucher"), score.cast("int").alias("score"), status.alias("status"))
    shown = F.transform(C.keyword_candidates(F.col("voucher"), F.col("score")),
                        lambda x: F.concat_ws(":", x["voucher"], x["score"].cast("string")))
    return rows.withColumn("candidates", F.array_join(shown, ","))


# ---------------------------------------------------------------- scores
def scored_rows(spark, sf):
    """Three scored labels per order, not sorted; some rows carry only one, some labels lie outside the taxonomy."""
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"))
    k = F.col("ord")
    s = lambda n, d: ((k * n) % 100).cast("double") / d
    label = lambda shift: F.when(k % 37 == shift, "Unknown voucher").otherwise(T.category_at(k + shift))
    many = F.array(F.struct(label(0).alias("label"), s(7, 100).alias("score")),
                   F.struct(label(7).alias("label"), s(3, 200).alias("score")),
                   F.struct(label(12).alias("label"), s(11, 300).alias("score")))
    return o.withColumn("scores", F.when(k % 13 == 0, F.slice(many, 1, 1)).otherwise(many))


def _label_sql(shift):
    return f"CASE WHEN k % 37 = {shift} THEN 'Unknown voucher' ELSE {category_sql(f'k + {shift}')} END"


cte("scored_long", (), " UNION ALL ".join(
    f"SELECT k AS ord, {_label_sql(sh)} AS label, CAST((k * {n}) % 100 AS DOUBLE) / {d} AS score FROM (SELECT o_orderkey AS k FROM orders) WHERE {cond}"
    for sh, n, d, cond in ((0, 7, 100, "true"), (7, 3, 200, "k % 13 <> 0"), (12, 11, 300, "k % 13 <> 0"))))
cte("scored_rank", ("scored_long",), "SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, label) AS rn FROM scored_long")
cte("scored", ("scored_rank",), """
SELECT ord, max(CASE WHEN rn = 1 THEN label END) AS category, max(CASE WHEN rn = 1 THEN score END) AS score,
 max(CASE WHEN rn = 1 THEN score END) - max(CASE WHEN rn = 2 THEN score END) AS margin FROM scored_rank GROUP BY ord""")


def top_scores(df, k=3):
    """Best k (label, score), highest first, label as the tie-break."""
    return df.withColumn("top_predictions", F.slice(F.transform(
        F.array_sort(F.transform("scores", lambda x: F.struct((-x["score"]).alias("neg"), x["label"].alias("label")))),
        lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("score"))), 1, k))


def with_ambiguity(df, rules=None):
    """score, margin, ambiguous and review flags from ordered predictions."""
    from voucherflow.config import Rules
    rules = rules or Rules()
    first, second = F.get("top_predictions", F.lit(0)), F.get("top_predictions", F.lit(1))
    df = df.select("*", first["label"].alias("category"), first["score"].alias("score"),
                   (first["score"] - second["score"]).alias("margin"))
    weak = F.coalesce(F.col("score") < rules.ambiguous_score_threshold, F.lit(False)) \
        | F.coalesce(F.col("margin") < rules.ambiguous_margin_threshold, F.lit(False))
    outside = ~F.col("category").isin(*schema.TAXONOMY)
    return df.withColumn("ambiguous", weak).withColumn("review_flags", F.array_compact(F.array(
        F.when(F.col("ambiguous"), "AMBIGUOUS_SCORE"), F.when(outside, "OUTSIDE_TAXONOMY"))))


@query("cls_12", with_("scored", f"""
SELECT ord, category, score, ambiguous, concat_ws(',', CASE WHEN ambiguous THEN 'AMBIGUOUS_SCORE' END,
 CASE WHEN category NOT IN ({lits(schema.TAXONOMY)}) THEN 'OUTSIDE_TAXONOMY' END) AS review_flags
FROM (SELECT *, score < 0.50 OR coalesce(margin < 0.15, false) AS ambiguous FROM scored)"""))
def cls_12(spark, sf):
    return with_ambiguity(top_scores(scored_rows(spark, sf))).select(
        "ord", "category", "score", "ambiguous", F.array_join("review_flags", ",").alias("review_flags"))


@query("cls_13", with_("scored", f"SELECT label FROM (SELECT unnest({sql_list(schema.TAXONOMY)}) AS label) WHERE label NOT IN (SELECT DISTINCT category FROM scored)"))
def cls_13(spark, sf):
    from voucherflow.functions.literals import fixed_table
    taxonomy = fixed_table(spark, "label", [(t,) for t in schema.TAXONOMY])
    known = with_ambiguity(top_scores(scored_rows(spark, sf))).select(F.col("category").alias("label")).distinct()
    return taxonomy.join(known, "label", "left_anti")


@query("win_03", with_("scored", "SELECT ord, score, margin FROM scored"))
def win_03(spark, sf):
    return with_ambiguity(top_scores(scored_rows(spark, sf))).select("ord", "score", "margin")


@query("top_01", with_("scored_rank", "SELECT ord, string_agg(label || ':' || CAST(CAST(round(score, 4) AS DECIMAL(6,4)) AS VARCHAR), ',' ORDER BY rn) AS top FROM scored_rank WHERE rn <= 3 GROUP BY ord"))
def top_01(spark, sf):
    text = F.transform("top_predictions", lambda x: F.concat_ws(":", x["label"], F.round(x["score"], 4).cast("decimal(6,4)").cast("string")))
    return top_scores(scored_rows(spark, sf)).select("ord", F.array_join(text, ",").alias("top"))


@query("cls_18", """
SELECT o_orderkey AS ord, coalesce(f.voucher, """ + category_sql("o_orderkey") + """) AS voucher, f.voucher IS NOT NULL AS verified
FROM orders LEFT JOIN (SELECT target, arg_max(voucher, event_id) AS voucher FROM (SELECT user_id AS target, event_id,
 CASE WHEN event_type = 'error' THEN 'Journal' ELSE 'Sales' END AS voucher FROM events) GROUP BY target) f ON f.target = o_orderkey""")
def cls_18(spark, sf):
    rows = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), T.category_at(F.col("o_orderkey")).alias("voucher"))
    fixes = T.table(spark, sf, "events").select(
        F.col("user_id").alias("ord"), F.col("event_id").alias("version"),
        F.when(F.col("event_type") == "error", "Journal").otherwise("Sales").alias("voucher"))
    return apply_corrections(rows, fixes, "ord")


def apply_corrections(rows, fixes, key):
    """Latest human correction per row wins; corrected rows become verified."""
    latest = fixes.groupBy(key).agg(F.max_by("voucher", "version").alias("fixed"))
    return rows.join(latest, key, "left").select(
        key, F.coalesce("fixed", "voucher").alias("voucher"), F.col("fixed").isNotNull().alias("verified"))

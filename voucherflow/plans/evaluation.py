"""Queries over labelled rows: contract features, TF-IDF, metrics, audits and adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.functions.literals import fixed_table
from voucherflow.functions.text import narration_core, neutral_identifier
from voucherflow.operators import adjudication as J
from voucherflow.operators import audit as Q
from voucherflow.operators import contract as CO
from voucherflow.operators import edits as ED
from voucherflow.operators import metrics as M
from voucherflow.operators import rules as R
from voucherflow.operators.features import once, once_each
from voucherflow.plans import classification as CL
from voucherflow.plans import console as CN
from voucherflow.plans import normalization as NR
from voucherflow.plans.ctes import CTES, category_sql, cte, lit, lits, sql_list, with_
from voucherflow.plans.registry import query
from voucherflow.sources import tables as T
from voucherflow.sources.wide import WIDE_COLUMNS, wide_vouchers

training = NR.training_rows
_HAVE = {"seller_supplier", "buyer_customer", "invoice_number", "item_description", "transaction_narration", "quantity", "unit_price",
         "taxable_value", "gst_rate_percent", "gst_amount", "currency", "payment_method", "payment_status", "return_reason",
         "debit_credit_info", "gross_pay_amount", "deductions_amount", "net_pay_amount"}
core = lambda: narration_core(F.col("transaction_narration"))


def _cell(n):
    return n if n in _HAVE else "CAST(NULL AS VARCHAR)"


def _close(a, b):
    return (f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN CASE WHEN abs(({a}) - ({b})) <= greatest(abs({a}), abs({b}), 1.0::DOUBLE) * 0.02::DOUBLE "
            f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END")


cte("prepared", ("training",), "SELECT ord, label, split_group, " + ", ".join(
    [f"{NR.mask_sql(_cell(n))} AS {n}" for n in schema.TEXT_FIELDS] + [f"{CL._fold(_cell(n))} AS {n}" for n in schema.CATEGORY_FIELDS]
    + [f"TRY_CAST({_cell(n)} AS DOUBLE) AS {n}" for n in schema.NUMERIC_FIELDS]
    + [f"CASE WHEN trim(CAST({_cell(n)} AS VARCHAR)) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_{n}" for n in schema.CONTRACT_FIELDS]
    + [f"{_close('quantity * unit_price', 'taxable_value')} AS {schema.RELATION_FIELDS[0]}",
       f"{_close('taxable_value * gst_rate_percent / 100.0::DOUBLE', 'gst_amount')} AS {schema.RELATION_FIELDS[1]}",
       f"{_close('gross_pay_amount - deductions_amount', 'net_pay_amount')} AS {schema.RELATION_FIELDS[2]}",
       f"{NR._CORE} AS core"]) + " FROM training")


def _tok(field, tag):
    return f"array_to_string(list_transform(regexp_extract_all({field}, '[a-z#]+'), lambda w: '{tag}' || w), ' ')"


_TOKENS = "concat_ws(' ', " + ", ".join(
    [f"nullif({_tok('transaction_narration', 'narr_')}, '')", f"nullif({_tok('item_description', 'item_')}, '')"]
    + [f"CASE WHEN {n} <> '' THEN '{n}=' || replace({n}, ' ', '_') END" for n in schema.CATEGORY_FIELDS]
    + [f"CASE WHEN has_{n} = 1 THEN 'has_{n}' ELSE 'no_{n}' END" for n in schema.CONTRACT_FIELDS]
    + [f"CASE WHEN {n} IS NOT NULL THEN '{n}=' || CAST(CAST({n} AS INT) AS VARCHAR) END" for n in schema.RELATION_FIELDS]) + ")"
cte("tokens", ("prepared",), f"SELECT ord, label, split_group, core, {_TOKENS} AS tokens FROM prepared")
_PREP = (*schema.TEXT_FIELDS, *schema.CATEGORY_FIELDS, "quantity", "taxable_value", "gst_amount", *[f"has_{n}" for n in schema.CONTRACT_FIELDS])


@query("ml_01", with_("prepared", f"SELECT ord, {', '.join(_PREP)} FROM prepared"))
def ml_01(spark, sf):
    return CO.prepare(training(spark, sf)).select("ord", *_PREP)


@query("ml_02", with_("prepared", f"SELECT ord, {', '.join(schema.RELATION_FIELDS)} FROM prepared"))
def ml_02(spark, sf):
    return CO.prepare(training(spark, sf)).select("ord", *schema.RELATION_FIELDS)


@query("ml_03", with_("tokens", "SELECT ord, tokens FROM tokens"))
def ml_03(spark, sf):
    return CO.prepare(training(spark, sf)).select("ord", CO.field_tokens().alias("tokens"))


@query("ml_05", with_("prepared", "SELECT ord, trim(transaction_narration || ' ' || item_description) AS contract_text FROM prepared"))
def ml_05(spark, sf):
    return CO.prepare(training(spark, sf)).select("ord", CO.contract_text().alias("contract_text"))


def _tfidf_sql(terms_cte, rows, having="df >= 2"):
    return f"""
, df AS (SELECT term, count(*) AS df FROM {terms_cte} GROUP BY 1 HAVING {having}),
w AS (SELECT key, term, (ln(tf) + 1.0::DOUBLE) * (ln((1.0::DOUBLE + (SELECT count(*) FROM {rows})) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS raw FROM {terms_cte} JOIN df USING (term)),
nn AS (SELECT key, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1)
SELECT key, term, round(raw / norm, 9) AS weight FROM w JOIN nn USING (key)"""


cte("texts", (), "SELECT doc_id AS key, text FROM documents UNION ALL SELECT -1, ''")
cte("doc_words", ("texts",), "SELECT key, list_transform(regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+'), lambda x: x) AS ws FROM texts")
cte("word_tf", ("doc_words",), """
SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM doc_words) GROUP BY 1, 2""")


@query("ml_06", with_("word_tf", "").rstrip() + _tfidf_sql("word_tf", "texts"))
def ml_06(spark, sf):
    """All documents and an empty one, which counts in the idf and has no weight."""
    empty = spark.range(-1, 0).select(F.col("id").alias("key"), F.lit("").alias("text"))
    d = T.spread(T.table(spark, sf, "documents")).select(F.col("doc_id").alias("key"), "text").unionByName(empty)
    out = CO.tfidf(CO.word_terms(d, "key", "text"), "key")
    return out.select("key", "term", F.round("weight", 9).alias("weight"))


_PAD = "(' ' || x || ' ')"
_GRAMS = ("list_concat(list_concat(" + ", ".join(
    f"CASE WHEN length({_PAD}) > {n} THEN list_transform(range(1, length({_PAD}) - {n} + 2), lambda i: substr({_PAD}, i, {n})) "
    f"WHEN length({_PAD}) = {n} THEN [{_PAD}] ELSE [] END" for n in (3, 4)) + "), "
    + f"CASE WHEN length({_PAD}) > 5 THEN list_transform(range(1, length({_PAD}) - 5 + 2), lambda i: substr({_PAD}, i, 5)) "
      f"WHEN length({_PAD}) = 5 THEN [{_PAD}] ELSE [] END)")
cte("part_words", ("prepared",), "SELECT ord AS key, unnest(regexp_extract_all(trim(transaction_narration || ' ' || item_description), '\\S+')) AS x FROM prepared")
cte("char_tf", ("part_words",), f"SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({_GRAMS}) AS term FROM part_words) GROUP BY 1, 2")


@query("ml_07", with_("char_tf", "").rstrip() + _tfidf_sql("char_tf", "prepared"))
def ml_07(spark, sf):
    d = CO.prepare(training(spark, sf)).select(F.col("ord").alias("key"), CO.contract_text().alias("text"))
    out = CO.tfidf(CO.char_terms(d, "key", "text"), "key")
    return out.select("key", "term", F.round("weight", 9).alias("weight"))


_PCT = "CAST('0x' || substr(md5(CAST(split_group AS VARCHAR) || '{}'), 1, 8) AS BIGINT) % 100 < 20"


@query("ml_10", with_("training", f"SELECT ord, split_group, CASE WHEN {_PCT.format('/test')} THEN 'test' WHEN {_PCT.format('/validation')} THEN 'validation' ELSE 'train' END AS part FROM training"))
def ml_10(spark, sf):
    return CO.split_by_group(training(spark, sf), "split_group").select("ord", "split_group", "part")


cte("holdout", ("prepared",), """
SELECT label, core, n_rows, rb < lr * 0.2::DOUBLE AND gb < lg - 1 AS held_out FROM (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY label ORDER BY md5(core) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb,
 row_number() OVER (PARTITION BY label ORDER BY md5(core)) - 1 AS gb, sum(n_rows) OVER (PARTITION BY label) AS lr, count(*) OVER (PARTITION BY label) AS lg
 FROM (SELECT label, core, count(*) AS n_rows FROM prepared GROUP BY 1, 2))""")


@query("win_05", with_("holdout", "SELECT label, core, n_rows, held_out FROM holdout"))
def win_05(spark, sf):
    return CO.group_holdout(training(spark, sf), "label", core())


@query("ml_11", with_("holdout", "SELECT label, held_out, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_groups FROM holdout GROUP BY 1, 2"))
def ml_11(spark, sf):
    return CO.group_holdout(training(spark, sf), "label", core()).groupBy("label", "held_out").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@query("ml_23", with_("predictions", "SELECT actual, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS sample_weight, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS balanced_weight FROM predictions GROUP BY 1"))
def ml_23(spark, sf):
    return CO.class_weights(CN.predictions(spark, sf), "actual").select("actual", "n", F.round("sample_weight", 9).alias("sample_weight"), F.round("balanced_weight", 9).alias("balanced_weight"))


# ---------------------------------------------------------------- metrics
def long_predictions(spark, sf):
    p = CN.predictions(spark, sf)
    return p.select("ord", "actual", "score", "split_group", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("pred_a").alias("predicted")), F.struct(F.lit("b").alias("model"), F.col("pred_b").alias("predicted")))).alias("e")).select(
        "ord", "actual", "score", "split_group", "e.*")


cte("long", ("predictions",), "SELECT ord, actual, score, split_group, 'a' AS model, pred_a AS predicted FROM predictions UNION ALL SELECT ord, actual, score, split_group, 'b', pred_b FROM predictions")
_CLASS = """
SELECT {by}, label, support, guessed, tp, CASE WHEN guessed > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS "precision", CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall,
 CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support)::DOUBLE ELSE 0 END AS f1 FROM (SELECT {by}, label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(g) AS BIGINT) AS guessed, CAST(sum(t) AS BIGINT) AS tp FROM (
 SELECT {by}, actual AS label, 1 AS s, 0 AS g, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS t FROM {src} UNION ALL SELECT {by}, predicted, 0, 1, 0 FROM {src}) GROUP BY ALL)"""
cte("classes", ("long",), _CLASS.format(by="model", src="long"))
_OVERALL = """SELECT {by}, CAST(sum(support) AS BIGINT) AS n_samples, CAST(sum(tp) AS BIGINT) AS correct, round(sum(tp) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(f1), 9) AS macro_f1_union,
 round(avg(CASE WHEN support > 0 THEN f1 END), 9) AS macro_f1_present, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM {src} GROUP BY {by}"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


_METRICS = ("accuracy", "macro_f1_union", "macro_f1_present", "weighted_f1")


@query("ml_16", with_("classes", _OVERALL.format(by="model", src="classes").replace("weighted_f1 FROM", f"weighted_f1, round(sum(CASE WHEN label IN ({lits(schema.TAXONOMY)}) THEN f1 ELSE 0 END) / 27.0::DOUBLE, 9) AS macro_f1_trained FROM")))
def ml_16(spark, sf):
    out = M.overall(M.pair_counts(long_predictions(spark, sf)), trained=list(schema.TAXONOMY))
    return _rounded(out, *_METRICS, "macro_f1_trained").select("model", "n_samples", "correct", *_METRICS, "macro_f1_trained")


@query("ml_17", with_("classes", 'SELECT model, label, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM classes'))
def ml_17(spark, sf):
    return _rounded(M.per_class(M.pair_counts(long_predictions(spark, sf))), "precision", "recall", "f1")


_LABELS = sorted(set(T.CATEGORY_BY_SLOT))


@query("ml_18", with_("predictions", f"SELECT l.label AS actual, " + ", ".join(f"count_if(pred_b = '{c}') AS \"{c}\"" for c in _LABELS)
                      + f" FROM (SELECT unnest({sql_list(_LABELS)}) AS label) l LEFT JOIN predictions ON actual = l.label GROUP BY 1"))
def ml_18(spark, sf):
    return M.confusion(M.pair_counts(long_predictions(spark, sf)), _LABELS, "b")


_CORRECTED = CL._correct_sql(1)
cte("before_after", ("canon_terms", "predictions"), f"""
SELECT c.ord, p.actual, 'before' AS model, c.prediction AS predicted, false AS moved FROM ({_CORRECTED}) c JOIN predictions p USING (ord)
UNION ALL SELECT c.ord, p.actual, 'after', c.corrected, c.corrected <> c.prediction FROM ({_CORRECTED}) c JOIN predictions p USING (ord)""")
cte("ba_classes", ("before_after",), _CLASS.format(by="model", src="before_after"))


@query("ml_19", with_("ba_classes", "SELECT o.model, n_samples, correct, accuracy, macro_f1_union, macro_f1_present, weighted_f1, corrections FROM ("
                      + _OVERALL.format(by="model", src="ba_classes") + ") o JOIN (SELECT model, count_if(moved) AS corrections FROM before_after GROUP BY 1) m USING (model)"))
def ml_19(spark, sf):
    from voucherflow.operators.correction import correct
    rows = correct(CL.canonical_rows(spark, sf), version=1).select("ord", "prediction", "corrected")
    rows = rows.join(CN.predictions(spark, sf).select("ord", "actual"), "ord")
    tall = rows.select("actual", F.explode(F.array(
        F.struct(F.lit("before").alias("model"), F.col("prediction").alias("predicted"), F.lit(False).alias("moved")),
        F.struct(F.lit("after").alias("model"), F.col("corrected").alias("predicted"), (F.col("corrected") != F.col("prediction")).alias("moved")))).alias("e")).select("actual", "e.*")
    pairs = tall.groupBy("model", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"))
    moved = pairs.groupBy("model").agg(F.sum("moved").alias("corrections"))
    return _rounded(M.overall(pairs), *_METRICS).join(moved, "model").select("model", "n_samples", "correct", *_METRICS, "corrections")


cte("arms", ("modelled", "evidence"), f"""
SELECT label AS actual, 'model_alone' AS model, model_prediction AS predicted FROM modelled
UNION ALL SELECT label, 'first_match_rules', coalesce(first, model_prediction) FROM (SELECT *, {CL._first_sql('all')} AS first FROM modelled)
UNION ALL SELECT label, 'evidence_rules', prediction FROM modelled""")
cte("arm_classes", ("arms",), _CLASS.format(by="model", src="arms"))


@query("ml_19_arms", with_("arm_classes", "SELECT model, n_samples, correct, accuracy, macro_f1_union, macro_f1_present, weighted_f1 FROM (" + _OVERALL.format(by="model", src="arm_classes") + ")"))
def ml_19_arms(spark, sf):
    """The model alone, under the first-match rules and under the evidence rules, on the same rows."""
    rows = R.with_model_fallback(R.first_match(CL._with_model(CL.decided(spark, sf)), "first"))
    arms = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("predicted")) for n, c in (
        ("model_alone", F.col("model_prediction")), ("first_match_rules", F.coalesce("first", "model_prediction")), ("evidence_rules", F.col("prediction")))])
    tall = rows.select(F.col(f"`{schema.LABEL_COLUMN}`").alias("actual"), F.explode(arms).alias("e")).select("actual", "e.*")
    return _rounded(M.overall(M.pair_counts(tall)), *_METRICS).select("model", "n_samples", "correct", *_METRICS)


@query("ml_20", with_("classes", "SELECT model, count_if(support > 0) AS n_classes, count_if(support > 0 AND recall >= 0.8::DOUBLE) AS classes_recall_ge_0_8, count_if(support > 0 AND recall = 0) AS classes_recall_eq_0 FROM classes GROUP BY 1"))
def ml_20(spark, sf):
    return M.overall(M.pair_counts(long_predictions(spark, sf))).select("model", F.col("classes_in_truth").alias("n_classes"), "classes_recall_ge_0_8", "classes_recall_eq_0")


@query("ml_22", with_("long", "SELECT model, actual, predicted, count(*) AS n, round(avg(score), 9) AS mean_score FROM long WHERE actual <> predicted GROUP BY 1, 2, 3"))
def ml_22(spark, sf):
    errors = long_predictions(spark, sf).filter("actual <> predicted")
    return errors.groupBy("model", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


@query("ml_22_rows", with_("scored_rank predictions", """
SELECT ord, actual, predicted, score, alternatives FROM (SELECT ord, max(label) FILTER (rn = 1) AS predicted, round(max(score) FILTER (rn = 1), 9) AS score,
  string_agg(label || ' (' || CAST(CAST(round(score, 3) AS DECIMAL(6,3)) AS VARCHAR) || ')', ' | ' ORDER BY rn) AS alternatives FROM scored_rank WHERE rn <= 3 GROUP BY ord)
JOIN (SELECT ord, actual FROM predictions) USING (ord) WHERE actual <> predicted"""))
def ml_22_rows(spark, sf):
    """The wrong rows with their score and the three best labels."""
    top = CL.top_scores(CL.scored_rows(spark, sf)).join(CN.predictions(spark, sf).select("ord", "actual"), "ord")
    text = F.transform("top_predictions", lambda x: F.concat(x["label"], F.lit(" ("), F.round(x["score"], 3).cast("decimal(6,3)").cast("string"), F.lit(")")))
    rows = top.select("ord", "actual", F.col("top_predictions")[0]["label"].alias("predicted"), F.round(F.col("top_predictions")[0]["score"], 9).alias("score"), F.array_join(text, " | ").alias("alternatives"))
    return rows.filter("actual <> predicted")


@query("qa_14_unknown", with_("modelled", f"SELECT category FROM (SELECT unnest({sql_list(sorted(set(R.CATEGORY.values())))}) AS category) WHERE category NOT IN (SELECT DISTINCT model_prediction FROM modelled WHERE model_prediction IS NOT NULL)"))
def qa_14_unknown(spark, sf):
    """Categories that a rule can give and the model never does."""
    known = CL._with_model(wide_vouchers(spark, sf)).select(F.col("model_prediction").alias("category")).distinct()
    return fixed_table(spark, "category", [(c,) for c in sorted(set(R.CATEGORY.values()))]).join(known, "category", "left_anti")


@query("ml_26", with_("classes", "SELECT model, metric, CASE WHEN metric = 'accuracy' THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT model FROM classes), (SELECT unnest(['accuracy', 'macro_f1']) AS metric)"))
def ml_26(spark, sf):
    """Recomputed metrics against a reported table with one figure per model off by 1e-6."""
    pairs = M.pair_counts(long_predictions(spark, sf))
    tall = lambda off: M.overall(pairs).select(F.explode(F.array(*[F.struct(F.concat_ws("/", "model", F.lit(m)).alias("k"), (F.col(c) + d).alias("value"))
                                                                  for m, c, d in (("accuracy", "accuracy", 0.0), ("macro_f1", "macro_f1_union", off))])).alias("e")).select("e.*")
    out = CN.compare_values(tall(1e-6), tall(0.0), "k")
    return out.select(F.split("k", "/")[0].alias("model"), F.split("k", "/")[1].alias("metric"), "status")


# ---------------------------------------------------------------- reviews
def review_cases(spark, sf):
    """Two reviewers per order: they agree, disagree or abstain by key."""
    k = F.col("k")
    o = T.spread(T.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("note"))
    synthetic = T.category_at(k)
    r1 = F.when(k % 35 == 0, J.ABSTAINED).when(k % 7 == 0, "Rejection In").otherwise(synthetic)
    r2 = F.when(k % 35 == 0, J.ABSTAINED).when(k % 11 == 0, J.ABSTAINED).when(k % 14 == 0, "Rejection Out").when(k % 5 == 0, T.category_at(k + 1)).otherwise(synthetic)
    narr = T.pick(k % 7, ("Event unclear, held for review", "Customer rejects goods. TXN-9 x", "Move own cash or bank money", "advance paid or received", "supplier invoice", "Reject note", "rent"))
    return o.select(
        F.concat(F.lit("HR-"), F.lpad((k + 1).cast("string"), 8, "0")).alias("review_case_id"), k.alias("ord"), synthetic.alias("synthetic"),
        r1.alias("reviewer_1_label"), r2.alias("reviewer_2_label"), (k % 4).cast("int").alias("reviewer_1_confidence"), (k % 3).cast("int").alias("reviewer_2_confidence"),
        F.when(k % 9 == 0, "CHECK").alias("reviewer_1_data_quality_flag"), F.when(k % 2 == 0, "NONE").alias("reviewer_2_data_quality_flag"),
        F.col("note").alias("reviewer_1_notes"), F.lit("seen").alias("reviewer_2_notes"),
        F.when(k % 3 != 0, "transaction_narration, payment_status,, return_reason").alias("reviewer_1_evidence_fields"), F.lit("whole row").alias("reviewer_2_evidence_fields"),
        narr.alias("transaction_narration"), T.pick(k % 5, ("Returned to supplier", "Prepaid", "Due", "", "Paid")).alias("payment_status"),
        T.pick(k % 3, ("Quality rejection", "Shift", "")).alias("movement_reason"), T.pick(k % 4, ("Material In note", "Invoice", "", "Memo")).alias("document_type"),
        T.pick(k % 6, ("Dr Trade Payable", "Cr Bank", "", "Receivable adj", "Cash Payable", "")).alias("debit_credit_info"),
        F.when(k % 8 == 0, "Advance Received").otherwise("goods").alias("item_description"),
        F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 3).cast("string"))).alias("seller_supplier"), F.when(k % 6 != 0, F.concat(F.lit("S"), (k % 2).cast("string"))).alias("buyer_customer"),
        F.when(k % 10 == 0, "Damaged").alias("return_reason"), ((r1 != r2) | (k % 35 == 0) | (k % 9 == 0)).alias("needs_adjudication"))


def _p(values, m):
    return f"({sql_list(values)})[k % {m} + 1]"


cte("cases", (), f"""
SELECT *, r1 <> r2 OR k % 35 = 0 OR k % 9 = 0 AS needs_adjudication FROM (SELECT 'HR-' || lpad(CAST(k + 1 AS VARCHAR), 8, '0') AS review_case_id, k, note, {category_sql('k')} AS synthetic,
 CASE WHEN k % 35 = 0 THEN 'NEEDS_ADJUDICATION' WHEN k % 7 = 0 THEN 'Rejection In' ELSE {category_sql('k')} END AS r1,
 CASE WHEN k % 35 = 0 THEN 'NEEDS_ADJUDICATION' WHEN k % 11 = 0 THEN 'NEEDS_ADJUDICATION' WHEN k % 14 = 0 THEN 'Rejection Out' WHEN k % 5 = 0 THEN {category_sql('k + 1')} ELSE {category_sql('k')} END AS r2,
 k % 4 AS c1, k % 3 AS c2, CASE WHEN k % 9 = 0 THEN 'CHECK' ELSE '' END AS f1, CASE WHEN k % 2 = 0 THEN 'NONE' ELSE '' END AS f2,
 CASE WHEN k % 3 <> 0 THEN 'transaction_narration, payment_status,, return_reason' ELSE '' END AS e1,
 {_p(("Event unclear, held for review", "Customer rejects goods. TXN-9 x", "Move own cash or bank money", "advance paid or received", "supplier invoice", "Reject note", "rent"), 7)} AS narr,
 {_p(("Returned to supplier", "Prepaid", "Due", "", "Paid"), 5)} AS st, {_p(("Quality rejection", "Shift", ""), 3)} AS mv, {_p(("Material In note", "Invoice", "", "Memo"), 4)} AS dt,
 {_p(("Dr Trade Payable", "Cr Bank", "", "Receivable adj", "Cash Payable", ""), 6)} AS dci, CASE WHEN k % 8 = 0 THEN 'Advance Received' ELSE 'goods' END AS item,
 CASE WHEN k % 4 <> 0 THEN 'S' || CAST(k % 3 AS VARCHAR) ELSE '' END AS sel, CASE WHEN k % 6 <> 0 THEN 'S' || CAST(k % 2 AS VARCHAR) ELSE '' END AS buy,
 CASE WHEN k % 10 = 0 THEN 'Damaged' ELSE '' END AS rr FROM (SELECT o_orderkey AS k, o_orderpriority AS note FROM orders))""")
cte("patterns", (), "SELECT * FROM (VALUES " + ", ".join(f"({lit(p)}, {lit(d)}, {sql_list([x for x in c.split('|') if x])})" for p, (d, c) in J.PATTERNS.items()) + ") AS t(pair, defs, cands)")
_UNCLEAR = f"regexp_matches(lower(narr), {lit(J.UNCLEAR)})"
_OTHER_C = sql_list(J.OTHER_POLICY[1].split("|"))
cte("judged", ("cases", "patterns"), f"""
SELECT *, CASE WHEN kind = 'BOTH_ABSTAINED' AND NOT other THEN '' ELSE replace(coalesce(p.defs, CASE WHEN other THEN 'DEF-10' ELSE '' END), '|', ', ') END AS definitions,
 coalesce(p.cands, CASE WHEN other THEN {_OTHER_C} ELSE CAST([] AS VARCHAR[]) END) AS candidates FROM (SELECT *, kind = 'BOTH_ABSTAINED' AND {_UNCLEAR} AS other FROM (SELECT *,
 CASE WHEN r1 = r2 THEN 'both: ' || r1 ELSE least(r1, r2) || ' vs ' || greatest(r1, r2) END AS pair_name,
 CASE WHEN r1 = 'NEEDS_ADJUDICATION' AND r2 = 'NEEDS_ADJUDICATION' THEN 'BOTH_ABSTAINED' WHEN r1 = 'NEEDS_ADJUDICATION' OR r2 = 'NEEDS_ADJUDICATION' THEN 'ONE_REVIEWER_ABSTAINED'
  WHEN r1 <> r2 THEN 'CONCRETE_LABEL_CONFLICT' WHEN f1 <> '' OR f2 NOT IN ('', 'NONE') THEN 'SAME_LABEL_WITH_QUALITY_FLAG' ELSE 'SAME_LABEL' END AS kind FROM cases WHERE needs_adjudication)) c
 LEFT JOIN patterns p ON p.pair = c.pair_name""")


def judged(spark, sf):
    return J.assess(review_cases(spark, sf).filter("needs_adjudication"))


@query("adj_01", with_("judged", "SELECT review_case_id, pair_name AS pair, kind FROM judged"))
def adj_01(spark, sf):
    return judged(spark, sf).select("review_case_id", "pair", "kind")


_OWN = f"regexp_matches(lower(narr), {lit(J.OWN_TRANSFER)}) AND (sel <> '' OR buy <> '')"
_ACC = sql_list(J.ACCOUNT_DEPENDENT)
_CONFLICTS = f"""concat_ws(' | ', CASE WHEN {_UNCLEAR} THEN 'Narration itself states the event is unclear / held for review' END,
 CASE WHEN contains(lower(narr), 'customer') AND st = 'Returned to supplier' THEN 'Narration attributes the rejection to a customer, but payment_status = ''Returned to supplier''' END,
 CASE WHEN starts_with(dt, 'Material') AND mv = 'Quality rejection' THEN 'document_type = ''' || dt || ''' but movement_reason = ''Quality rejection''' END,
 CASE WHEN contains(lower(narr), 'reject') AND mv NOT IN ('', 'Quality rejection') THEN 'Narration describes a rejection, but movement_reason = ''' || mv || '''' END,
 CASE WHEN {_OWN} THEN CASE WHEN sel <> '' AND buy <> '' AND sel <> buy THEN 'Narration describes an own-account transfer, but party fields name two different parties: ' || sel || ', ' || buy
  ELSE 'Narration describes an own-account transfer; party fields name only ''' || CASE WHEN sel <> '' THEN sel ELSE buy END || ''' (confirm this is the entity itself)' END END,
 CASE WHEN contains(lower(narr), 'paid or received') THEN 'Narration does not say whether the advance was paid or received' END,
 CASE WHEN contains(lower(item), 'advance received') AND st IN ('Prepaid', 'Paid in advance') THEN 'item_description = ''' || item || ''' but payment_status = ''' || st || '''' END,
 CASE WHEN dci <> '' AND NOT regexp_matches(lower(dci), 'cash|bank') AND regexp_matches(lower(dci), 'payable|receivable') THEN 'debit_credit_info names no cash/bank account: ''' || dci || '''' END,
 CASE WHEN dci = '' AND list_has_any({_ACC}, list_concat(candidates, [r1, r2])) THEN 'debit_credit_info is empty (accounts debited/credited not recorded)' END)"""


@query("adj_02", with_("judged", f"SELECT review_case_id, {_CONFLICTS} AS conflicts FROM judged"))
def adj_02(spark, sf):
    return judged(spark, sf).select("review_case_id", "conflicts")


_NARR1 = "CASE WHEN regexp_matches(narr, 'TXN-\\d+') THEN trim(regexp_extract(regexp_extract(narr, '(?s)^(.*?)TXN-\\d+', 1), '(?s)^(.*\\.)', 1)) ELSE narr END"


@query("adj_03", with_("judged", f"""
SELECT review_case_id, 'Reviewer 1 ' || CASE WHEN r1 = 'NEEDS_ADJUDICATION' THEN 'abstained' ELSE 'chose ' || r1 END || ' (confidence ' || CAST(c1 AS VARCHAR) || '/3, quality flag: '
 || CASE WHEN f1 = '' THEN 'none recorded' ELSE f1 END || '). Note: ' || note || ' Cited: ' || CASE WHEN e1 = '' THEN '' ELSE 'transaction_narration=' || {_NARR1} || '; payment_status='
 || CASE WHEN st = '' THEN '(empty)' ELSE st END || '; return_reason=' || CASE WHEN rr = '' THEN '(empty)' ELSE rr END END AS reviewer_1,
 'Reviewer 2 ' || CASE WHEN r2 = 'NEEDS_ADJUDICATION' THEN 'abstained' ELSE 'chose ' || r2 END || ' (confidence ' || CAST(c2 AS VARCHAR) || '/3, quality flag: '
 || CASE WHEN f2 = '' THEN 'none recorded' ELSE f2 END || '). Note: seen Cited: whole row' AS reviewer_2 FROM judged"""))
def adj_03(spark, sf):
    fields = ["transaction_narration", "payment_status", "movement_reason", "document_type", "debit_credit_info", "item_description", "seller_supplier", "buyer_customer", "return_reason"]
    rows = review_cases(spark, sf).filter("needs_adjudication")
    return rows.select("review_case_id", J.cited_evidence(1, fields).alias("reviewer_1"), J.cited_evidence(2, fields).alias("reviewer_2"))


_PRIO = ("CASE WHEN other THEN 'HIGH' WHEN kind = 'CONCRETE_LABEL_CONFLICT' AND definitions <> '' THEN 'HIGH' WHEN kind IN ('CONCRETE_LABEL_CONFLICT', 'SAME_LABEL_WITH_QUALITY_FLAG') THEN 'MEDIUM' "
         "WHEN definitions <> '' THEN 'MEDIUM' WHEN kind = 'BOTH_ABSTAINED' THEN 'MEDIUM' ELSE 'LOW' END")
_WHY = ("CASE WHEN other THEN 'Both reviewers abstained on a record that decides the Other / Miscellaneous policy (DEF-10)' WHEN kind = 'CONCRETE_LABEL_CONFLICT' AND definitions <> '' THEN "
        "'Two concrete labels conflict on an open definition (' || definitions || ')' WHEN kind = 'CONCRETE_LABEL_CONFLICT' THEN 'Two concrete labels conflict; the definition itself is not disputed' "
        "WHEN kind = 'SAME_LABEL_WITH_QUALITY_FLAG' THEN 'Reviewers agree but a quality flag was raised; label depends on ' || CASE WHEN definitions = '' THEN 'record check' ELSE definitions END "
        "WHEN definitions <> '' THEN 'One reviewer abstained on an open definition (' || definitions || ')' WHEN kind = 'BOTH_ABSTAINED' THEN 'Both reviewers abstained; decide whether any label is supported' "
        "ELSE 'One reviewer abstained; no open definition issue applies (see Field Conflicts or Gaps)' END")


@query("adj_04", with_("judged", f"SELECT review_case_id, {_PRIO} AS priority, {_WHY} AS priority_reason FROM judged"))
def adj_04(spark, sf):
    return judged(spark, sf).select("review_case_id", "priority", "priority_reason")


cte("ranked_cases", ("judged",), f"""
SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, pair_rows DESC, pair_name, review_case_id) AS queue_rank
FROM (SELECT *, {_PRIO} AS priority, count(*) OVER (PARTITION BY pair_name) AS pair_rows FROM judged)""")


@query("adj_05", with_("ranked_cases", "SELECT queue_rank, review_case_id, pair_name AS pair, kind, priority, definitions, pair_rows, "
                                       "array_to_string(list_concat(candidates, list_filter(CASE WHEN r1 = r2 THEN [r1] ELSE [r1, r2] END, lambda x: x <> 'NEEDS_ADJUDICATION' AND NOT list_contains(candidates, x))), ' | ') AS candidate_categories FROM ranked_cases"))
def adj_05(spark, sf):
    return J.build_queue(review_cases(spark, sf).filter("needs_adjudication")).select(
        "queue_rank", "review_case_id", "pair", "kind", "priority", "definitions", "pair_rows", "candidate_categories")


@query("adj_types", with_("judged", f"SELECT pair_name AS pair, kind, {_PRIO} AS priority, definitions, count(*) AS n_records FROM judged GROUP BY ALL"))
def adj_types(spark, sf):
    return J.type_table(judged(spark, sf))


@query("adj_06", with_("cases", "SELECT count(*) AS reviewed, count(DISTINCT review_case_id) AS unique_ids, count_if(NOT needs_adjudication) AS consensus, count_if(needs_adjudication) AS flagged FROM cases"))
def adj_06(spark, sf):
    return J.reconcile(review_cases(spark, sf))


def review_queue(spark, sf):
    o, k = T.table(spark, sf, "orders").filter("o_orderkey % 3 <> 1"), F.col("o_orderkey")
    return o.select(k.alias("queue_row"), F.concat(F.lit("REC-"), k.cast("string")).alias("record_id"), (k % 25).alias("split_group"))


@query("jon_03", with_("cases", "SELECT review_case_id, k % 3 <> 1 AS linked, CASE WHEN k % 3 <> 1 THEN k % 25 ELSE -1 END AS split_group, 0 AS duplicate_keys FROM cases"))
def jon_03(spark, sf):
    cases, queue = review_cases(spark, sf), review_queue(spark, sf)
    joined = J.link_cases(cases.select("review_case_id"), queue)
    twice = J.duplicate_keys(queue, "queue_row").select("queue_row").withColumn("twice", F.lit(1).cast("bigint"))
    return joined.join(twice, "queue_row", "left").select("review_case_id", F.col("record_id").isNotNull().alias("linked"),
                                                          F.coalesce("split_group", F.lit(-1).cast("bigint")).alias("split_group"), F.coalesce("twice", F.lit(0).cast("bigint")).alias("duplicate_keys"))


@query("jon_04", with_("cases", "SELECT review_case_id, 'REC-' || CAST(k AS VARCHAR) AS record_id FROM cases WHERE k % 3 <> 1 AND needs_adjudication"))
def jon_04(spark, sf):
    return J.link_cases(review_cases(spark, sf).filter("needs_adjudication").select("review_case_id"), review_queue(spark, sf)).filter("record_id IS NOT NULL").select("review_case_id", "record_id")


@query("jon_07", with_("judged", "SELECT review_case_id, pair_name AS pair, p_hit AS known_pattern, definitions FROM (SELECT *, pair IS NOT NULL AS p_hit FROM judged)"))
def jon_07(spark, sf):
    known = F.broadcast(J.pattern_table(spark).select("pair", F.lit(True).alias("known")))
    return judged(spark, sf).join(known, "pair", "left").select("review_case_id", "pair", F.coalesce("known", F.lit(False)).alias("known_pattern"), "definitions")


@query("ml_15", with_("cases train_text", """
SELECT c.review_case_id, k % 25 AS split_group, c.r1 AS target, md5(t.text_input) AS text_digest FROM cases c JOIN train_text t ON t.ord = c.k
WHERE NOT needs_adjudication AND k % 3 <> 1 AND trim(c.r1) <> '' AND length(t.text_input) > 0"""))
def ml_15(spark, sf):
    consensus = review_cases(spark, sf).filter("NOT needs_adjudication").select("review_case_id", "ord", F.trim("reviewer_1_label").alias("target"))
    df = training(spark, sf)
    texts = df.select("ord", NR.make_text(df, NR._TEXT_COLS).alias("text_input"))
    rows = J.link_cases(consensus, review_queue(spark, sf)).join(texts, "ord")
    return rows.filter((F.col("target") != "") & F.col("split_group").isNotNull() & (F.length("text_input") > 0)).select(
        "review_case_id", "split_group", "target", F.md5("text_input").alias("text_digest"))


cte("quality", ("cases",), "SELECT synthetic AS label, count(*) AS reviewed, count_if(r1 = synthetic) AS reviewer_1_agrees, count_if(r2 = synthetic) AS reviewer_2_agrees, count_if(NOT needs_adjudication) AS consensus FROM cases GROUP BY 1")


def label_quality(cases):
    """Per class: reviewed rows, agreement of each reviewer with the class, and consensus rows."""
    c = F.col
    return cases.groupBy(c("synthetic").alias("label")).agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(c("reviewer_1_label") == c("synthetic")).alias("reviewer_1_agrees"),
        F.count_if(c("reviewer_2_label") == c("synthetic")).alias("reviewer_2_agrees"), F.count_if(~c("needs_adjudication")).alias("consensus"))


@query("qa_04", with_("quality", "SELECT * FROM quality"))
def qa_04(spark, sf):
    return label_quality(review_cases(spark, sf))


@query("ml_25", with_("quality classes", """
SELECT q.label, CASE WHEN q.label = 'Journal' THEN 'Not trained' WHEN c.recall >= 0.8::DOUBLE THEN 'Recovered on unseen synthetic sentences' ELSE 'Not reliably recovered' END
 || CASE WHEN q.label <> 'Journal' AND least(reviewer_1_agrees, reviewer_2_agrees) < 0.75::DOUBLE * reviewed THEN ' (label disputed by a reviewer)' ELSE '' END AS status
FROM quality q LEFT JOIN classes c ON c.label = q.label AND c.model = 'b'"""))
def ml_25(spark, sf):
    c = F.col
    classes = M.per_class(M.pair_counts(long_predictions(spark, sf).filter("model = 'b'"))).select("label", "recall")
    rows = label_quality(review_cases(spark, sf)).join(classes, "label", "left")
    disputed = F.least("reviewer_1_agrees", "reviewer_2_agrees") < 0.75 * c("reviewed")
    base = F.when(c("recall") >= 0.8, "Recovered on unseen synthetic sentences").otherwise("Not reliably recovered")
    return rows.select("label", F.when(c("label") == "Journal", "Not trained").otherwise(
        F.concat(base, F.when(disputed, " (label disputed by a reviewer)").otherwise(""))).alias("status"))


# ---------------------------------------------------------------- audits
_INPUTS = [c for c in ("seller_supplier", "buyer_customer", "item_description", "transaction_narration", "currency", "payment_method", "payment_status", "return_reason", "debit_credit_info")]
_NEAR = [c for c in _INPUTS if c != "transaction_narration"]
_KEY = lambda cols: "md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, '~none~')" for c in cols) + "))"
cte("audit_rows", ("training",), f"SELECT label, split_group, {_KEY(_INPUTS)} AS k, {_KEY(_NEAR)} AS near, {NR._CORE} AS core FROM training")


@query("qa_01", with_("audit_rows", """
SELECT (SELECT count(*) FROM audit_rows) AS n_rows, (SELECT count(DISTINCT label) FROM audit_rows) AS classes,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM audit_rows GROUP BY k)) AS identical_inputs,
 (SELECT count(*) FROM (SELECT k FROM audit_rows GROUP BY k HAVING count(DISTINCT label) > 1)) AS identical_inputs_conflicting,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM audit_rows GROUP BY near)) AS near_duplicates,
 (SELECT count(DISTINCT core) FROM audit_rows) AS sentences, (SELECT count(*) FROM (SELECT core FROM audit_rows GROUP BY core HAVING count(DISTINCT split_group) > 1)) AS sentences_across_groups"""))
def qa_01(spark, sf):
    return Q.data_audit(training(spark, sf), "label", _INPUTS, _NEAR, core(), "split_group")


@query("qa_02", with_("audit_rows", "SELECT count(*) AS straddling FROM audit_rows WHERE split_group < 5 AND near IN (SELECT near FROM audit_rows WHERE split_group >= 5)"))
def qa_02(spark, sf):
    rows = training(spark, sf).select("split_group", Q.row_key(training(spark, sf), _NEAR).alias("near"))
    return rows.filter("split_group < 5").join(rows.filter("split_group >= 5").select("near").distinct(), "near", "left_semi").agg(F.count(F.lit(1)).alias("straddling"))


@query("qa_03")
def qa_03(spark, sf):
    values = {"core": core(), "status": F.lower(F.trim("payment_status")), "item": F.lower(F.trim("item_description"))}
    found = Q.shared_value_components(training(spark, sf), "ord", values)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))


@query("qa_05", with_("prepared", "SELECT label, count(DISTINCT core) AS narration_sentences, count(DISTINCT split_group) AS split_groups FROM prepared GROUP BY 1"))
def qa_05(spark, sf):
    return training(spark, sf).groupBy("label").agg(F.countDistinct(core()).alias("narration_sentences"), F.countDistinct("split_group").alias("split_groups"))


_SIG = "concat_ws(',', " + ", ".join(f"CASE WHEN \"{c}\" IS NOT NULL THEN '{c}' END" for c in WIDE_COLUMNS) + ")"
cte("sigs", ("wide",), f'SELECT ord, {_SIG} AS sig, "{schema.LABEL_COLUMN}" AS label FROM wide')


def _cells(spark, sf):
    return Q.signature_cells(wide_vouchers(spark, sf), list(WIDE_COLUMNS), schema.LABEL_COLUMN)


@query("qa_06", with_("sigs", "SELECT s.label, count(*) AS n_rows, count(DISTINCT s.sig) AS signatures, bool_or(d.n > 1) AS shared FROM sigs s JOIN (SELECT sig, count(DISTINCT label) AS n FROM sigs GROUP BY 1) d USING (sig) GROUP BY 1"))
def qa_06(spark, sf):
    return Q.signature_by_category(_cells(spark, sf))


@query("win_06", with_("sigs", """
SELECT (SELECT count(DISTINCT sig) FROM sigs) AS distinct_signatures, CAST(coalesce(sum(n), 0) AS BIGINT) AS loo_correct FROM (SELECT sig, label, count(*) AS n FROM sigs GROUP BY 1, 2) own
WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT sig, label, count(*) AS n FROM sigs GROUP BY 1, 2) o WHERE o.sig = own.sig AND o.label <> own.label AND (o.n > own.n - 1 OR (o.n = own.n - 1 AND o.label < own.label)))"""))
def win_06(spark, sf):
    return Q.leave_one_out(_cells(spark, sf))


_IDS = [c for c in schema.OWN_ID_COLUMNS + schema.REFERENCE_ID_COLUMNS if c in WIDE_COLUMNS]


@query("qa_07", with_("wide", "SELECT id_column, prefix, count(*) AS n_rows, string_agg(DISTINCT label, ', ' ORDER BY label) AS categories FROM (" + " UNION ALL ".join(
    f'SELECT {lit(c)} AS id_column, regexp_extract({CL.trim_sql(chr(34) + c + chr(34))}, \'^[A-Z-]*[A-Z]\') AS prefix, "{schema.LABEL_COLUMN}" AS label FROM wide WHERE {NR._filled_sql(c)}' for c in _IDS) + ") GROUP BY 1, 2"))
def qa_07(spark, sf):
    return Q.identifier_prefixes(wide_vouchers(spark, sf), schema.LABEL_COLUMN)


# ablation: rules under three identifier treatments and three clause modes, with and without a model
_CONFIGS = (("A", "plain", "all"), ("B", "plain", "no_own_prefix"), ("C", "removed", "all"), ("D", "neutralized", "all"), ("E", "plain", "presence_only"))


def ablation_rows(df, key, label, model):
    """(config, fallback, row, actual, predicted, rule prediction, prediction of A): one pass, all treatments side by side."""
    ids = [c for c in schema.OWN_ID_COLUMNS + schema.REFERENCE_ID_COLUMNS if c in df.columns and c in R.USED_FIELDS]
    rows = R.with_field_bits(df, "held_")
    rows = rows.select(key, F.col(f"`{label}`"), *[c for c in rows.columns if c.startswith("held_")], *[F.col(f"`{c}`") for c in ids])
    clean = {c: F.col(f"__id{i}") for i, c in enumerate(ids)}
    rows = once_each(rows, {f"__id{i}": R.field_columns(rows, [c])[c] for i, c in enumerate(ids)}, R.AT_ONCE).drop(*ids)
    changes = {"plain": {}, "removed": {c: F.lit("") for c in ids},
               "neutralized": {c: F.when(v != "", neutral_identifier(v)).otherwise("") for c, v in clean.items()}}
    for variant, change in changes.items():
        rows = R.with_evidence(rows, f"{variant}_", change, "held_")
    rows = rows.select(key, F.col(f"`{label}`").alias("actual"), model.alias("model_prediction"), *[f"{v}_clause_bits" for v in changes])
    for cid, variant, mode in _CONFIGS:
        rows = R.first_match(rows, f"p_{cid}", mode, f"{variant}_")
    final = lambda c, fallback: F.coalesce(f"p_{c}", *([F.lit(R.UNCLASSIFIED)] if fallback == "none" else ["model_prediction"]))
    arms = [F.struct(F.lit(c).alias("config"), F.lit(fb).alias("fallback"), F.col(f"p_{c}").alias("rule_prediction"),
                     final(c, fb).alias("predicted"), final("A", fb).alias("base")) for c, _, _ in _CONFIGS for fb in ("none", "model")]
    return rows.select(key, "actual", F.explode(F.array(*arms)).alias("e")).select(key, "actual", "e.*")


def _variant_cte(mode):
    cells = ", ".join(
        (f"CASE WHEN {NR._filled_sql(c)} THEN {'NULL' if mode == 'removed' else NR.neutral_sql(chr(34) + c + chr(34))} ELSE \"{c}\" END" if c in _IDS else f'"{c}"') + f' AS "{c}"' for c in WIDE_COLUMNS)
    return f'SELECT ord, source_ref, {cells}, "{schema.LABEL_COLUMN}" FROM wide'


for _mode in ("removed", "neutralized"):
    cte(f"wide_{_mode}", ("wide",), _variant_cte(_mode))
    cte(f"clean_{_mode}", (f"wide_{_mode}",), f'SELECT ord, source_ref, "{schema.LABEL_COLUMN}" AS label, {CL._fields_select()} FROM wide_{_mode}')
    cte(f"evidence_{_mode}", (f"clean_{_mode}",), CTES["evidence"][1].replace("FROM wide_clean", f"FROM clean_{_mode}"))
cte("ablation", ("evidence", "evidence_removed", "evidence_neutralized"), " UNION ALL ".join(
    f"SELECT '{c}' AS config, ord, label AS actual, {CL._first_sql(m)} AS rule_prediction, {category_sql('ord + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END')} AS model_prediction FROM evidence{'' if v == 'plain' else '_' + v}"
    for c, v, m in _CONFIGS))
cte("ablation_long", ("ablation",), "SELECT config, 'none' AS fallback, ord, actual, rule_prediction, coalesce(rule_prediction, 'Unclassified') AS predicted FROM ablation UNION ALL SELECT config, 'model', ord, actual, rule_prediction, coalesce(rule_prediction, model_prediction) FROM ablation")
cte("ablation_classes", ("ablation_long",), _CLASS.format(by="config, fallback", src="ablation_long"))


@query("qa_08", with_("ablation_classes", """
SELECT a.config, a.fallback, fired, fired_correct, o.correct, o.accuracy, o.macro_f1_union, o.weighted_f1, changed_vs_a FROM (
 SELECT l.config, l.fallback, count(l.rule_prediction) AS fired, count_if(l.rule_prediction = l.actual) AS fired_correct, count_if(l.predicted <> b.predicted) AS changed_vs_a
 FROM ablation_long l JOIN (SELECT fallback, ord, predicted FROM ablation_long WHERE config = 'A') b USING (fallback, ord) GROUP BY 1, 2) a
JOIN (""" + _OVERALL.format(by="config, fallback", src="ablation_classes") + ") o USING (config, fallback)"))
def qa_08(spark, sf):
    rows = ablation_rows(wide_vouchers(spark, sf), "ord", schema.LABEL_COLUMN, T.category_at(F.col("ord") + F.when(F.col("ord") % 9 == 0, 1).otherwise(0)))
    pairs = rows.groupBy("config", "fallback", "actual", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.count("rule_prediction").alias("fired"), F.count_if(F.col("rule_prediction") == F.col("actual")).alias("fired_correct"),
        F.count_if(F.col("predicted") != F.col("base")).alias("changed"))
    totals = pairs.groupBy("config", "fallback").agg(F.sum("fired").alias("fired"), F.sum("fired_correct").alias("fired_correct"), F.sum("changed").alias("changed_vs_a"))
    return _rounded(M.overall(pairs, ("config", "fallback")), "accuracy", "macro_f1_union", "weighted_f1").join(totals, ["config", "fallback"]).select(
        "config", "fallback", "fired", "fired_correct", "correct", "accuracy", "macro_f1_union", "weighted_f1", "changed_vs_a")


@query("qa_09", "SELECT 0 AS changed, count(*) AS n_rows FROM orders")
def qa_09(spark, sf):
    """Labels of the neighbouring row and earlier outputs injected as columns: no decision may move."""
    df = wide_vouchers(spark, sf)
    next_label = df.select((F.col("ord") - 1).alias("ord"), F.col(f"`{schema.LABEL_COLUMN}`").alias("shifted"))
    # As many rows as the table, which a size taken from compressed files may not show: never sent through the driver.
    injected = df.drop(schema.LABEL_COLUMN).join(next_label.hint("merge"), "ord", "left").withColumnRenamed("shifted", schema.LABEL_COLUMN).withColumn("Correct", F.lit("False"))
    return Q.mismatches(R.decide(df.drop(schema.LABEL_COLUMN)), R.decide(injected), "ord", "rule_category")


@query("qa_10", "SELECT 0 AS changed, count(*) AS n_rows FROM orders")
def qa_10(spark, sf):
    df = wide_vouchers(spark, sf)
    return Q.mismatches(R.decide(df), R.decide(df.repartition(7, F.xxhash64("source_ref"))), "ord", "rule_status")


cte("trace", ("evidence",), "SELECT ord, label, c0, " + ", ".join(f"c{c.bit}" for c in R.CLAUSES[1:]) + f", c{R.GUARDED_BIT}, {CL._cats_sql(guarded=True)} AS cats FROM evidence")


def rule_trace(df):
    """Deciding rule, clause kinds behind it, all matched rules and whether only a prefix supports it."""
    rows = R.first_match(R.with_evidence(df), "rule_prediction")
    bits = R.masked_bits("all")
    rid = F.coalesce(*[F.when(R.has_any(bits, R.RULE_MASK[r]), r) for r in R.RULE_IDS])
    rows = rows.select("*", bits.alias("bits"), rid.alias("rule_id"))
    kinds = F.concat_ws(" | ", *[F.when(R.has_any(F.col("bits"), 1 << c.bit) & (F.col("rule_id") == c.rule), c.kind) for c in R.CLAUSES])
    matched = F.concat_ws(", ", *[F.when(R.has_any(F.col("bits"), R.RULE_MASK[r]), r) for r in R.RULE_IDS])
    rows = rows.withColumns({"clause_kinds": kinds, "rules_matched": matched})
    alone = F.concat(F.lit(" | "), F.col("clause_kinds"), F.lit(" | ")).contains(" | field presence only | ")
    return rows.withColumn("needs_prefix", F.when(F.col("rule_id").isNull(), "n/a").when(alone, "No").otherwise("Yes"))


_DIGITS = "array_to_string(regexp_extract_all({0}, '\\d+'), '')"


def _edit_sql(case, field, how):
    if how == "-":
        return "NULL"
    if how == "~":
        return NR.neutral_sql(f"coalesce(\"{field}\", '')")
    if how.startswith("#"):
        return f"{lit(how[1:])} || " + _DIGITS.format(f'"{case.id_column}"')
    return lit(how)


def _edited_cte():
    new = {}
    for case in ED.cases():
        for field, how in case.edits:
            if field in WIDE_COLUMNS:
                new.setdefault(field, []).append(f"WHEN case_id = '{case.name}' THEN {_edit_sql(case, field, how)}")
    cells = ", ".join((f'CASE {" ".join(new[c])} ELSE "{c}" END' if c in new else f'"{c}"') + f' AS "{c}"' for c in WIDE_COLUMNS)
    fits = ", ".join(f"CASE WHEN starts_with({CL.field_sql(c.id_column)}, {lit(c.prefix)}) THEN '{c.name}' END" for c in ED.cases())
    return f'SELECT ord, source_ref, case_id, {cells}, "{schema.LABEL_COLUMN}" FROM (SELECT *, unnest([{fits}]) AS case_id FROM wide) WHERE case_id IS NOT NULL'


cte("edited", ("wide",), _edited_cte())
cte("clean_edited", ("edited",), f'SELECT ord, source_ref, case_id, "{schema.LABEL_COLUMN}" AS label, {CL._fields_select()} FROM edited')
cte("evidence_edited", ("clean_edited",), CTES["evidence"][1].replace("FROM wide_clean", "FROM clean_edited"))
_G = lambda c: f"c{R.GUARDED_BIT if c.bit == 1 else c.bit}"
_RID = "CASE " + " ".join(f"WHEN {' OR '.join(_G(c) for c in R.CLAUSES if c.rule == r)} THEN '{r}'" for r in R.RULE_IDS) + " END"
_KINDS = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {_G(c)} AND rule_id = '{c.rule}' THEN '{c.kind}' END" for c in R.CLAUSES) + ")"
_MATCHED = "concat_ws(', ', " + ", ".join(f"CASE WHEN {' OR '.join(_G(c) for c in R.CLAUSES if c.rule == r)} THEN '{r}' END" for r in R.RULE_IDS) + ")"
_ALONE = " OR ".join(f"({_G(c)} AND rule_id = '{c.rule}')" for c in R.CLAUSES if c.kind == "field presence only")
cte("traced", ("trace",), f"SELECT ord, label, rule_id, {_KINDS} AS clause_kinds, {_MATCHED} AS rules_matched, CASE WHEN rule_id IS NULL THEN 'n/a' WHEN {_ALONE} THEN 'No' ELSE 'Yes' END AS needs_prefix, cats[1] AS rule_prediction FROM (SELECT *, {_RID} AS rule_id FROM trace)")


cte("traced_edited", ("evidence_edited",), f"SELECT ord, case_id, rule_id, replace({_KINDS}, ' | ', ' / ') AS kinds, cats[1] AS pred, coalesce(cats[1], {category_sql('ord + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END')}) AS final, "
    f"CASE case_id {' '.join(f'WHEN {lit(c.name)} THEN {lit(c.expectation)}' for c in ED.cases())} END AS expected FROM (SELECT *, {_RID} AS rule_id, {CL._cats_sql(guarded=True)} AS cats FROM evidence_edited)")


@query("qa_11", with_("traced_edited", """
SELECT ord, case_id, rule_id, CASE WHEN rule_id IS NULL AND regexp_matches(expected, '^(AMBIGUOUS|CONFLICT)') THEN 'No rule fired; model decided (' || final || ') without a review flag'
 WHEN rule_id IS NULL THEN 'No rule fired despite remaining evidence; model decided (' || final || ')' WHEN expected = 'AMBIGUOUS' THEN 'Rule resolved an ambiguous record via ' || kinds
 WHEN expected = 'CONFLICT' THEN 'Conflict not detected; rule chose ' || pred || ' via ' || kinds
 WHEN starts_with(expected, 'CONFLICT (') THEN CASE WHEN expected = 'CONFLICT (fields: ' || pred || ')' THEN 'Followed field evidence (' || kinds || '); conflict not flagged' ELSE 'Followed identifier prefix against field evidence (' || kinds || ')' END
 WHEN pred = expected THEN CASE WHEN contains(kinds, 'prefix') THEN 'Correct, via ' || kinds ELSE 'Correct, via remaining field evidence' END ELSE 'Contradicted remaining evidence via ' || kinds END AS verdict FROM traced_edited"""))
def qa_11(spark, sf):
    traced = rule_trace(ED.edited_rows(wide_vouchers(spark, sf)))
    return ED.assess(traced, T.category_at(F.col("ord") + F.when(F.col("ord") % 9 == 0, 1).otherwise(0))).select("ord", "case_id", "rule_id", "verdict")


@query("qa_12", with_("traced", "SELECT ord, rule_id, clause_kinds, rules_matched, needs_prefix, rule_prediction = label AS correct FROM traced"))
def qa_12(spark, sf):
    return rule_trace(wide_vouchers(spark, sf)).select("ord", "rule_id", "clause_kinds", "rules_matched", "needs_prefix",
                                                       (F.col("rule_prediction") == F.col(f"`{schema.LABEL_COLUMN}`")).alias("correct"))


def _mode_rid(mode):
    off = {"all": lambda c: False, "no_own_prefix": lambda c: c.own is not None, "presence_only": lambda c: c.own is not None or c.reference is not None}[mode]
    arms = []
    for r in R.RULE_IDS:
        own = [_G(c) for c in R.CLAUSES if c.rule == r and not off(c)]
        if own:
            arms.append(f"WHEN {' OR '.join(own)} THEN '{r}'")
    return "CASE " + " ".join(arms) + " ELSE 'FALLBACK' END"


@query("qa_13", with_("evidence", f"SELECT m.mode, m.rule_id, count(e.rule_id) AS n_rows FROM (SELECT mode, rule_id FROM (SELECT unnest({sql_list(R.MODES)}) AS mode), (SELECT unnest({sql_list((*R.RULE_IDS, 'FALLBACK'))}) AS rule_id)) m LEFT JOIN ("
                      + " UNION ALL ".join(f"SELECT '{m}' AS mode, {_mode_rid(m)} AS rule_id FROM evidence" for m in R.MODES) + ") e USING (mode, rule_id) GROUP BY 1, 2"))
def qa_13(spark, sf):
    rows = R.with_evidence(wide_vouchers(spark, sf))
    rid = lambda mode: F.coalesce(*[F.when(R.has_any(R.masked_bits(mode), R.RULE_MASK[r]), r) for r in R.RULE_IDS], F.lit("FALLBACK"))
    fired = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), rid(m).alias("rule_id")) for m in R.MODES])).alias("e")).select("e.*")
    counts = fired.groupBy("mode", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    every = fixed_table(spark, "mode rule_id", [(m, r) for m in R.MODES for r in (*R.RULE_IDS, "FALLBACK")])
    return every.join(counts, ["mode", "rule_id"], "left").select("mode", "rule_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("qa_14", with_("modelled evidence", f"""
SELECT count(*) AS n_rows, count_if(first = model_prediction) AS agreement, round(avg(CASE WHEN first <> model_prediction THEN model_score END), 9) AS overridden_mean_score,
 round(avg(model_score), 9) AS mean_score, round(avg(CASE WHEN model_prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM (SELECT *, {CL._first_sql('all')} AS first FROM modelled)"""))
def qa_14(spark, sf):
    rows = R.first_match(CL._with_model(R.with_evidence(wide_vouchers(spark, sf))), "first")
    c = F.col
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c("first") == c("model_prediction")).alias("agreement"),
                    F.round(F.avg(F.when(c("first") != c("model_prediction"), c("model_score"))), 9).alias("overridden_mean_score"), F.round(F.avg("model_score"), 9).alias("mean_score"),
                    F.round(F.avg((c("model_prediction") == c(f"`{schema.LABEL_COLUMN}`")).cast("double")), 9).alias("accuracy"))


@query("qa_15", with_("wide", f"SELECT '{schema.LABEL_COLUMN}' AS column_name, count(\"{schema.LABEL_COLUMN}\") AS n_filled FROM wide"))
def qa_15(spark, sf):
    df = wide_vouchers(spark, sf)
    names = fixed_table(spark, "column_name", [(c,) for c in df.columns]).filter(F.col("column_name").rlike(Q.ANSWER_WORDS))
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    tall = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_filled")) for c in df.columns])).alias("e")).select("e.*")
    return tall.join(names, "column_name", "left_semi")


@query("qa_16", "SELECT DISTINCT d.doc_id, v.token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_/-]+')) AS token FROM documents) d JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z0-9_/-]+')) AS token FROM benchmark) v USING (token)")
def qa_16(spark, sf):
    """Documents holding any word of the benchmark items; ASCII words, whole texts."""
    values = T.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\w/-]+"), 0)).alias("value"))
    return Q.rows_holding_values(T.table(spark, sf, "documents"), "doc_id", "text", values).select("doc_id", "token")


@query("qa_17", with_("wide", f"""
SELECT label, n AS support, (SELECT count(*) FROM wide) AS n_rows, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM wide GROUP BY source_ref)) AS duplicates
FROM (SELECT "{schema.LABEL_COLUMN}" AS label, count(*) AS n FROM wide GROUP BY 1)"""))
def qa_17(spark, sf):
    df = wide_vouchers(spark, sf)
    by_label = df.groupBy(F.col(f"`{schema.LABEL_COLUMN}`").alias("label")).agg(F.count(F.lit(1)).alias("support"))
    dup = CN.duplicated(df.select("source_ref"), ["source_ref"])
    from pyspark.sql import Window as W
    counted = by_label.withColumn("n_rows", F.sum("support").over(W.partitionBy(F.lit(1))))
    return counted.withColumn("one", F.lit(1)).join(F.broadcast(dup.withColumn("one", F.lit(1))), "one").select("label", "support", "n_rows", F.col("duplicated_rows").alias("duplicates"))


@query("qa_18", with_("predictions", f"SELECT part, label FROM (SELECT unnest(['train', 'test']) AS part), (SELECT unnest({sql_list(schema.TAXONOMY)}) AS label) EXCEPT SELECT CASE WHEN split_group < 5 THEN 'test' ELSE 'train' END, actual FROM predictions"))
def qa_18(spark, sf):
    wanted = fixed_table(spark, "part label", [(p, t) for p in ("train", "test") for t in schema.TAXONOMY])
    seen = CN.predictions(spark, sf).select(F.when(F.col("split_group") < 5, "test").otherwise("train").alias("part"), F.col("actual").alias("label")).distinct()
    return wanted.join(seen, ["part", "label"], "left_anti")


@query("snk_04", with_("classes", 'SELECT model, label, round(recall, 4) AS recall, support FROM classes'))
def snk_04(spark, sf):
    return M.per_class(M.pair_counts(long_predictions(spark, sf))).select("model", "label", F.round("recall", 4).alias("recall"), "support")


@query("snk_01", with_("decision", f'SELECT ord, label AS "{schema.LABEL_COLUMN}", prediction AS "Predicted Voucher Category", rule_status AS "Rule Status", review_required AS "Review Required", prediction = label AS "Correct" FROM decision'))
def snk_01(spark, sf):
    rows = R.decision_columns(CL._with_model(CL.decided(spark, sf)))
    return rows.select("ord", F.col(f"`{schema.LABEL_COLUMN}`"), F.col("prediction").alias("Predicted Voucher Category"), F.col("rule_status").alias("Rule Status"),
                       F.col("review_required").alias("Review Required"), (F.col("prediction") == F.col(f"`{schema.LABEL_COLUMN}`")).alias("Correct"))

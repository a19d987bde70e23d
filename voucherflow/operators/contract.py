"""Feature contract of the training row: text, categories, numbers, presence and relationships; tokens and TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.functions.parsing import fold_space, trim_all
from voucherflow.functions.text import mask_text
from voucherflow.operators import term_blocks as TB
from voucherflow.operators.features import once
from voucherflow.operators.ranking import in_percent, in_ranges, running_before

ALL_GROUPS = ("narration", "item", "categorical", "presence", "relationships")
TOLERANCE = 0.02   # fixed value: relative tolerance of the relationship features


def close(a: Column, b: Column) -> Column:
    """1.0 when the two agree within the relative tolerance, 0.0 when not, null when either is missing."""
    limit = F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * TOLERANCE
    return F.when(a.isNotNull() & b.isNotNull(), (F.abs(a - b) <= limit).cast("double"))


def prepare(df: DataFrame, keys: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One row per input row with contract columns only; missing fields become empty."""
    have = set(df.columns)
    cell = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    out = [F.col(k) for k in keys if k in have]
    out += [mask_text(cell(n)).alias(n) for n in schema.TEXT_FIELDS]
    out += [fold_space(cell(n)).alias(n) for n in schema.CATEGORY_FIELDS]
    out += [cell(n).try_cast("double").alias(n) for n in schema.NUMERIC_FIELDS]
    out += [F.when(trim_all(cell(n).cast("string")) != "", 1.0).otherwise(0.0).alias(f"has_{n}") for n in schema.CONTRACT_FIELDS]
    base = df.select(*out)
    c = F.col
    return base.withColumns({
        schema.RELATION_FIELDS[0]: close(c("quantity") * c("unit_price"), c("taxable_value")),
        schema.RELATION_FIELDS[1]: close(c("taxable_value") * c("gst_rate_percent") / 100.0, c("gst_amount")),
        schema.RELATION_FIELDS[2]: close(c("gross_pay_amount") - c("deductions_amount"), c("net_pay_amount"))})


def _tagged(tag: str):
    return lambda w: F.concat(F.lit(tag), w)


def field_tokens(groups: tuple[str, ...] = ALL_GROUPS) -> Column:
    """Token text over prepared columns: every token carries the name of its field."""
    parts: list[Column] = []
    for group, field, tag in (("narration", "transaction_narration", "narr_"), ("item", "item_description", "item_")):
        if group in groups:
            found = F.regexp_extract_all(F.col(field), F.lit("[a-z#]+"), 0)
            parts.append(F.array_join(F.transform(found, _tagged(tag)), " "))
    if "categorical" in groups:
        parts += [F.when(F.col(n) != "", F.concat(F.lit(f"{n}="), F.replace(F.col(n), F.lit(" "), F.lit("_")))) for n in schema.CATEGORY_FIELDS]
    if "presence" in groups:
        parts += [F.when(F.col(f"has_{n}") == 1.0, f"has_{n}").otherwise(f"no_{n}") for n in schema.CONTRACT_FIELDS]
    if "relationships" in groups:
        parts += [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("int").cast("string"))) for n in schema.RELATION_FIELDS]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]) if parts else F.lit("")


def contract_text(fields: tuple[str, ...] = schema.TEXT_FIELDS) -> Column:
    return trim_all(F.concat_ws(" ", *[F.col(f) for f in fields]))


def with_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """For each named array of terms, `<name>_distinct` and `<name>_counts`: its distinct terms in order and how often each occurs.

    Runs of the sorted array are cut inside the row, so counting the terms of a document moves no row.
    """
    at_least_one = lambda c: F.greatest(F.size(c), F.lit(1))
    df = once(df, {f"__o_{n}": F.array_sort(n) for n in names})
    same = lambda o: F.zip_with(o, F.slice(F.concat(F.array(F.lit(None).cast("string")), o), 1, at_least_one(o)), lambda x, y: x.eqNullSafe(y))
    df = once(df, {f"__s_{n}": same(F.col(f"__o_{n}")) for n in names})             # whether a term equals the one before it
    df = once(df, {f"__f_{n}": F.filter(F.transform(f"__s_{n}", lambda x, i: F.when(~x, i)), lambda x: x.isNotNull()) for n in names})
    ends = lambda n: F.slice(F.concat(F.col(f"__f_{n}"), F.array(F.size(f"__o_{n}"))), 2, at_least_one(F.col(f"__f_{n}")))     # a run ends where the next one starts
    df = once(df, {f"{n}_distinct": F.filter(F.zip_with(f"__o_{n}", f"__s_{n}", lambda x, y: F.when(~y, x)), lambda x: x.isNotNull()) for n in names}
              | {f"{n}_counts": F.filter(F.zip_with(ends(n), F.col(f"__f_{n}"), lambda x, y: x - y), lambda x: x.isNotNull()) for n in names})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the lower-cased words of each row's text."""
    return df.select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\S+"), 0).alias("words"))


def word_terms(df: DataFrame, key: str, text: str, lo: int = 1, hi: int = 2) -> TB.Terms:
    """Word n-grams of each row's text, cut from its words."""
    return TB.Terms(_words(df, key, text), "words", TB.word_runs(lo, hi), hi - lo + 1)


def char_terms(df: DataFrame, key: str, text: str, lo: int = 3, hi: int = 5) -> TB.Terms:
    """Character n-grams inside the blank-padded words of each row's text, as `padded_char_ngrams` cuts them."""
    return TB.Terms(_words(df, key, text), "words", TB.char_runs(lo, hi), 4 * (hi - lo + 1))


def tfidf(rows: DataFrame | TB.Terms, key: str, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(key, term, weight) of counted terms, or of rows (key, terms): sublinear counts, smooth idf over all rows (also those without a term), unit length.

    Terms are counted inside blocks of rows (`term_blocks`): a term moves once for each block to its frequency and, if it is frequent enough, back to the block.
    """
    return TB.tfidf(rows if isinstance(rows, TB.Terms) else TB.Terms(rows, "terms", TB.same_words, 1), key, min_df, max_features)


def split_by_group(df: DataFrame, group: str) -> DataFrame:
    """test / validation / train by a hash of the group: about 20 / 16 / 64 %, never splitting a group."""
    test, val = in_percent(F.col(group), "/test"), in_percent(F.col(group), "/validation")
    return df.withColumn("part", F.when(test < 20, "test").when(val < 20, "validation").otherwise("train"))


def group_holdout(df: DataFrame, label: str, core: Column, share: float = 0.20) -> DataFrame:
    """Per label: whole groups, in hash order, until the share of its rows is reached; one group held, one kept."""
    sizes = df.groupBy(F.col(label).alias("label"), core.alias("core")).agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumns({"h": F.md5("core"), "one": F.lit(1).cast("bigint")})
    sizes = in_ranges(sizes, [F.col("label"), F.col("h")], "__range")
    walked = running_before(sizes, ["label"], F.col("__range"), [F.col("h")], "n_rows", "rows_before")
    walked = running_before(walked, ["label"], F.col("__range"), [F.col("h")], "one", "groups_before")
    totals = sizes.groupBy("label").agg(F.sum("n_rows").alias("label_rows"), F.count(F.lit(1)).alias("label_groups"))
    held = (F.col("rows_before") < F.col("label_rows") * share) & (F.col("groups_before") < F.col("label_groups") - 1)
    return walked.join(totals, "label").select("label", "core", "n_rows", held.alias("held_out"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Sampling weight 1/n and balanced weight n_total/(classes*n) per label."""
    from pyspark.sql import Window as W
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))     # one row per label
    return counts.select(label, "n", (F.lit(1.0) / F.col("n")).alias("sample_weight"),
                         (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("balanced_weight"))

"""Text building, masking and n-grams without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherflow import schema
from voucherflow.functions.parsing import clean_field, fold_space, trim_all

# How generated references and document codes look.
REFERENCE_MARK = r"TXN-\d+"
ID_TOKEN = r"\b[A-Za-z]{2,}[-/]?\d[\w-]*\b"
ID_LIKE = r"^[A-Z]{2,}[A-Z-]*-?\d{3,}$"
SENSITIVE_NAMES = (
    "gstin|name|party|supplier|customer|vendor|exporter|importer|company|organi[sz]ation|employee|address|bank|"
    "account|phone|email|pan|ifsc|contact|principal|processor|contractor|subcontractor|payer|payee|approved|"
    "authori[sz]ed|inspected|counted|adjusted"
)


def narration_sentence(c: Column) -> Column:
    """Narration up to the last full stop before the generated reference mark; unchanged without a mark."""
    before = F.regexp_extract(c, rf"(?s)^(.*?){REFERENCE_MARK}", 1)
    cut = F.regexp_extract(before, r"(?s)^(.*\.)", 1)
    return F.when(c.rlike(REFERENCE_MARK), cut).otherwise(c)


def narration_core(c: Column) -> Column:
    """The sentence with digits masked, folded to lower case."""
    return fold_space(F.regexp_replace(narration_sentence(c), r"\d+", "#"))


def narration_verbatim(c: Column) -> Column:
    return F.when(c.rlike(REFERENCE_MARK), trim_all(narration_sentence(c))).otherwise(c)


def mask_text(c: Column) -> Column:
    """Identifiers become 'idtoken', digits '#'; blanks folded, lower case."""
    masked = F.regexp_replace(F.regexp_replace(c.cast("string"), ID_TOKEN, " idtoken "), r"\d+", "#")
    return fold_space(masked)


def format_value(c: Column, dtype: str) -> Column:
    """Cell as text for serialising; null when empty or a null token."""
    if dtype in ("double", "float"):
        text = F.when(F.isnan(c), None).when(c == F.floor(c), c.cast("bigint").cast("string")) \
            .otherwise(c.cast("string"))
    else:
        text = trim_all(c.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin(*schema.FIELD_NULLS), text)


def labelled_text(pairs: list[tuple[str, Column]], separator: str = " | ") -> Column:
    """'Name: value' for every non-null value, joined; concat_ws skips the nulls."""
    return F.concat_ws(separator, *[F.concat(F.lit(f"{name}: "), value) for name, value in pairs])


def neutral_identifier(c: Column) -> Column:
    digits = F.array_join(F.regexp_extract_all(c.cast("string"), F.lit(r"\d+"), 0), "-")
    return F.when(digits == "", "DOC").otherwise(F.concat(F.lit("DOC-"), digits))


def words(c: Column, pattern: str = r"\S+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def word_ngrams(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """All runs of lo..hi tokens, joined by one blank."""
    grams = []
    for n in range(lo, hi + 1):
        span = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
        grams.append(F.when(span > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(span, F.lit(1))), _run_of(tokens, n))).otherwise(F.array().cast("array<string>")))
    return F.concat(*grams)


# A lambda given to F.transform must take exactly the element, so sizes are bound by closures.
def _run_of(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")


def _piece_of(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def padded_char_ngrams(word: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of one word padded with a blank on each side.

    A padded word no longer than n counts once, as itself, and longer sizes are then skipped.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    parts = []
    for n in range(lo, hi + 1):
        whole = F.array(padded) if n == lo else F.array().cast("array<string>")
        parts.append(F.when(size > n, F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), _piece_of(padded, n)))
            .when(size == n, F.array(padded) if n > lo else whole).otherwise(whole))
    return F.concat(*parts)


def clean_category(c: Column) -> Column:
    return fold_space(c)


def present_text(c: Column) -> Column:
    return F.when(clean_field(c) != "", clean_field(c))

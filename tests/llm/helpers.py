"""Small tables with the cases that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    """Documents of (doc_id, text[, lang[, source]]) over a few partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def awkward(spark):
    """Null id, text, language and source; empty, blank and long texts; repeated rows; columns whose names operators use themselves."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, "one two three four five six\nseven eight", "en", "a"), (1, "one two three four five six\nseven eight", "en", "a"), (None, "one two three", None, None), (None, None, "de", "b"),
            (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "fr", "c"), (5, long, "en", "a"), (6, long, "en", "a"), (7, "Ünï çode 😀 <|im_end|> a@b.co", "de", "b"), (7, "other text", "de", "b")]
    return docs(spark, rows).withColumns({"score": F.lit("x"), "shard": F.lit(1), "h": F.lit("h"), "id": F.lit(2.5), "fp": F.lit(None).cast("string"), "size": F.array(F.lit(1))})


def invented(seed, words, vocabulary):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(words))


VOCABULARY = {
    "en": "the of and over under river stone house walking thinking weather mother brother nothing shall would right".split(),
    "de": "der die das und über unter fluss stein haus gehen denken wetter mutter bruder nichts würde recht schön".split(),
    "fr": "le la les et sur sous rivière pierre maison marcher penser temps mère frère rien serait droit beauté".split(),
}

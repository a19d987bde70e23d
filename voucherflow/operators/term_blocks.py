"""TF-IDF weights by blocks of rows: a term travels once for each block that holds it, not once for each row.

Rows are cut where they lie into blocks of a bounded number of words (a longer row is a block of its own). A block is written once to
`spark.checkpoint.dir`: its keys, its distinct terms in byte order, and for every row the places of its terms in that order and how often each occurs. The terms of
all blocks are added up to document frequencies, the frequent ones go back to their blocks, and weights are taken there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voucherflow.operators.text_models import _gram_terms, _words
from voucherflow.session import ensure_checkpoint_dir

BLOCK_TERMS = 1 << 20       # terms of a block, repeats included, as its words lead to expect
WRITTEN = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


@dataclass(frozen=True)
class Terms:
    """Rows (key, words) and how their terms are cut from the words; `per_word` is about how many terms a word gives."""
    rows: DataFrame
    words: str
    cut: Callable
    per_word: int


def same_words(row, code, words):
    return row, code, words


def word_runs(lo: int, hi: int) -> Callable:
    """Runs of lo..hi words of a row, joined by one blank."""
    def cut(row: np.ndarray, code: np.ndarray, words: pa.Array):
        rows, codes, names, known = [], [], [], 0
        at, runs, here = np.arange(len(row)), code, words      # places where a run starts, the run's code and the runs by code
        for n in range(1, hi + 1):
            if n > 1:
                on = at + n - 1 < len(row)
                on[on] = row[at[on] + n - 1] == row[at[on]]
                at, pair = at[on], runs[on] * max(1, len(words)) + code[at[on] + n - 1]
                pair, runs = np.unique(pair, return_inverse=True)
                left, right = np.divmod(pair, max(1, len(words)))
                here = pc.binary_join_element_wise(here.take(pa.array(left)), words.take(pa.array(right)), pa.scalar(" ", words.type))
            if n >= lo:
                rows, codes, names, known = [*rows, row[at]], [*codes, runs + known], [*names, here], known + len(here)
        return np.concatenate(rows), np.concatenate(codes), pa.concat_arrays(names)
    return cut


def char_runs(lo: int, hi: int) -> Callable:
    return lambda row, code, words: _gram_terms(row, code, words, lo, hi)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), "<i4") if n else np.empty(0, "<i4")


def _block(keys: pa.Array, words, cut: Callable, number: int, names: list[str]) -> pa.RecordBatch:
    row, code, terms = cut(*words)
    coded = pc.dictionary_encode(terms)         # words that hold a blank may read like two words
    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], coded.dictionary.cast(pa.string())
    used, code = np.unique(code, return_inverse=True)
    terms = terms.take(pa.array(used))
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = max(1, len(order))
    key, n = np.unique(row * width + rank[code], return_counts=True)
    at, term = np.divmod(key, width)
    of = [keys, terms.take(pa.array(order)), pa.array(np.bincount(term, minlength=len(order)).astype(np.int64)),
          pa.array(np.bincount(term, n, minlength=len(order)).astype(np.int64))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in of]
    blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.bincount(at, minlength=len(keys)), term, n)]
    return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([len(term)], pa.int64()), *blobs], names)


def blocks(given: Terms, key: str) -> DataFrame:
    """The written blocks: block, keys, terms, n_rows and n_times of each term, entries, and row sizes, places and counts as packed numbers."""
    spark, folder = given.rows.sparkSession, f"{ensure_checkpoint_dir(given.rows.sparkSession).rstrip('/')}/terms-{uuid.uuid4().hex}"
    kind = given.rows.schema[key].dataType
    schema = f"block long, keys array<{kind.simpleString()}>, terms array<string>, n_rows array<long>, n_times array<long>, entries long, sizes binary, places binary, counts binary"
    names = ["block", "keys", "terms", "n_rows", "n_times", "entries", "sizes", "places", "counts"]
    words, cut, most = given.words, given.cut, max(1, BLOCK_TERMS // given.per_word)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            share = np.cumsum(size) // most
            cuts = np.r_[0, np.flatnonzero(np.diff(share)) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = batch.slice(a, b - a)
                yield _block(some.column(key), _words(some, words), cut, number, names)
                number += 1
    # A block is a long row. Parquet looks at the size of what it holds after 100 rows at first, which then do not fit a task; here it looks after each.
    given.rows.select(key, words).mapInArrow(run, schema).write.options(**WRITTEN).parquet(folder)
    return spark.read.parquet(folder)


def tfidf(given: Terms, key: str, min_df: int, max_features: int | None) -> DataFrame:
    """(key, term, weight): sublinear counts, smooth idf over all rows (also those without a term), unit length for each key.

    Rows with one key, null included, share its length; only where keys repeat do rows meet by key.
    """
    held = blocks(given, key)
    spark, kind = held.sparkSession, given.rows.schema[key].dataType
    total = held.agg(F.coalesce(F.sum(F.size("keys").cast("long")), F.lit(0)).alias("n_docs"))         # one row
    each = held.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("terms", "n_rows", "n_times")).alias("place", "e")).select(
        "of", "place", F.col("e.terms").alias("term"), F.col("e.n_rows").alias("n_rows"), F.col("e.n_times").alias("n_times"))
    if max_features:
        df = each.groupBy("term").agg(F.sum("n_rows").alias("df"), F.sum("n_times").alias("corpus_tf")).filter(F.col("df") >= min_df)
        found = each.select("of", "place", "term").join(df.orderBy(F.desc("corpus_tf"), "term").limit(max_features).select("term", "df"), "term")
    else:       # a term has one row for each block that holds it
        found = each.select("of", "place", "term", F.sum("n_rows").over(W.partitionBy("term")).alias("df")).filter(F.col("df") >= min_df)
    found = found.join(F.broadcast(total)).select("of", "place", (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    arrow_key = to_arrow_type(kind)

    def weigh(whole: bool):
        """Rows' weights, with their length beside them; or, with `whole`, only each row's squared length."""
        def run(left, right):
            out = []
            place, idf = right.column("place").to_numpy(), right.column("idf").to_numpy()
            for block in left.to_batches():
                for i in range(block.num_rows):
                    cell = lambda name: block.column(name)[i]
                    keys, n = cell("keys").values, cell("entries").as_py()
                    terms = cell("terms").values
                    of = np.zeros(len(terms))
                    of[place] = idf
                    term, count = (_unpacked(cell(c).as_py(), n) for c in ("places", "counts"))
                    row = np.repeat(np.arange(len(keys)), _unpacked(cell("sizes").as_py(), len(keys)))
                    kept = of[term] > 0         # an idf is over 0, as no term is in more rows than there are
                    row, term = row[kept], term[kept]
                    raw = (np.log(count[kept].astype(np.float64)) + 1.0) * of[term]
                    square = np.bincount(row, raw * raw, minlength=len(keys)).astype(np.float64)       # adds a row's terms in their order
                    columns = [keys, pa.array(square)] if whole else [keys.take(pa.array(row)), terms.take(pa.array(term)), pa.array(raw), pa.array(np.sqrt(square)[row])]
                    out.append(pa.Table.from_arrays([columns[0].cast(arrow_key), *columns[1:]], names[whole]))
            return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.nulls(0, t) for t in types[whole]], names[whole])
        return run
    names = {False: [key, "term", "raw", "norm"], True: [key, "square"]}
    types = {False: [arrow_key, pa.string(), pa.float64(), pa.float64()], True: [arrow_key, pa.float64()]}
    quoted = f"`{key}` {kind.simpleString()}"
    meet = lambda whole, schema: held.select("block", "keys", "terms", "entries", "sizes", "places", "counts").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(weigh(whole), schema)
    rows = meet(False, f"{quoted}, term string, raw double, norm double")
    again = held.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.limit(1).isEmpty():
        length = meet(True, f"{quoted}, square double").select(F.col(key).alias("__k"), "square").groupBy("__k").agg(F.sqrt(F.sum("square")).alias("__norm"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        rows = rows.join(length, F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("norm", F.coalesce("__norm", "norm"))
    return rows.select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))

"""Phrases of two and more words that occur often and hold together, found through mergeable Misra-Gries summaries and then counted exactly.

Texts are cut into pieces at `.,;:!?` and line breaks and pieces into words at spaces and tabs, with A-Z lower-cased; a phrase is a run of words within a
piece. All counts are per language (null: `und`). A phrase is a candidate if it occurs `threshold` times or more. Cutting it after its
first k words gives floor(1000 a n / (l r)), with a, l and r the occurrences of the phrase and its two parts and n those of all words; the
lowest cut counts, ties to the smallest k. A candidate inside a longer one that occurs as often is dropped. The best `top` of each
language stay, by score, then occurrences, then phrase in byte order.

Passes. The texts are tokenised once; each piece of text becomes a row of word codes, its distinct words and their 64-bit hashes in the shared run folder.
Words are counted exactly. Then pairs, and after them all longer runs at once, take two passes over the codes:
1. Summaries. Phrase hashes are dealt to hash partitions, and each task keeps a Misra-Gries summary of `CAPACITY` counters for each; where a summary is over that,
   its (CAPACITY + 1)-th largest count is taken off all of its counters. There are so many partitions that the capacity is SLACK times the
   partition's mean mass divided by the threshold. Summaries are merged by adding counters in Spark's aggregate, which takes nothing off, and each reports what it
   took off at most; a phrase that is frequent is left with threshold - loss or more. A loss over half of the threshold, which only a very uneven
   dealing could bring about, repeats the pass with twice the partitions. So every frequent phrase survives, whatever the data.
2. The survivors alone are counted exactly, first inside each task, then over all.
Only occurrences that can belong to a frequent phrase enter a summary: pairs of frequent words, and longer runs all of whose pairs are frequent. Frequent words and pairs
and the survivors are sorted hash arrays in files, cut by hash range, which workers map; nothing is broadcast and no phrase reaches the driver. Hashes tell
words of a language, and phrases within a task, apart; the counts of tasks are added by the phrase itself.

Rows: a null text is empty; blank texts have no phrase; texts are taken whole, a long one in one task; repeated rows and null ids count as
they occur; an empty table gives no rows. Only text and lang are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherflow.llm.common import KeySet, dealt, pieces, run_folder, slices, store_keys

CAPACITY = 1 << 16      # counters of a summary
SLACK = 4
SLICE = 4 << 20         # bytes of text in one row of codes
OUT_ROWS = 1 << 16
WAITING = 1 << 20       # keys that wait before they enter a summary
HELD = 1 << 19          # phrases that a task counts before it passes them on

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")], _KIND[list(b".,;:!?\n\x0b\x0c\r")] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- words -----------------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and whether each is the first of its piece."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    rows = at[:-1] - at[0]
    kind = _KIND[data]
    word = kind == 0
    start = word & ~np.r_[False, word[:-1]][:len(word)]
    heads = rows[rows < len(word)]
    start[heads] = word[heads]
    starts = np.flatnonzero(start)
    place = (np.cumsum(word) - 1)[starts]
    ends = np.r_[place, word.sum()].astype(np.int32)
    flat = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOWER[data[word]].tobytes())])
    piece = np.cumsum(kind == 2)[starts] + np.searchsorted(rows, starts, side="right")
    return flat, np.r_[True, piece[1:] != piece[:-1]][:len(starts)]


def word_keys(words: list[str], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _squeezed(codes: np.ndarray) -> bytes:
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _codes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


ENCODED = "lang string, n_words long, codes binary, words array<string>, counts array<long>, hashes array<long>"


def _encode(batches):
    """One row for each piece of text and language: codes (1 and up; 0 before each piece), distinct words, their counts and hashes."""
    for part in slices(batches, "text", SLICE):
        langs = pc.dictionary_encode(part.column("lang"))
        which = langs.indices.to_numpy(zero_copy_only=False)
        for n, lang in enumerate(langs.dictionary.to_pylist()):
            flat, first = split_words(part.column("text").filter(pa.array(which == n)))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words = coded.dictionary.to_pylist()
            full = np.zeros(len(code) + int(first.sum()), np.int64)
            full[np.arange(len(code)) + np.cumsum(first)] = code + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([len(code)]), pa.array([_squeezed(full)], pa.binary()), pa.array([words], pa.list_(pa.string())),
                 pa.array([np.bincount(code, minlength=len(words))], pa.list_(pa.int64())), pa.array([word_keys(words, lang).view(np.int64)], pa.list_(pa.int64()))],
                ["lang", "n_words", "codes", "words", "counts", "hashes"])


def _rows(batch):
    """Each row of codes; its lists stay arrays, as objects of every word would take many times their room."""
    for n in range(batch.num_rows):
        row = {c: batch.column(c)[n] for c in batch.schema.names}
        yield {c: x.values if isinstance(x, pa.ListScalar) else x.as_py() for c, x in row.items()}


# ---- phrases ---------------------------------------------------------------

def _joined(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15) + more
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def phrases(row, words: KeySet, pairs: KeySet | None, longest: int):
    """(size, starts, hashes) of the runs in one row of codes that may be frequent: pairs of frequent words, or, given the frequent pairs, the longer runs of them."""
    codes = _codes(row["codes"])
    known = row["hashes"].to_numpy(zero_copy_only=False).view(np.uint64)
    h, ok = np.r_[np.uint64(0), known][codes], np.r_[False, words.has(known)][codes]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    key = _joined(h[at], h[at + 1])
    if pairs is None:
        yield 2, at, key
        return
    linked = np.zeros(len(codes), bool)
    linked[at] = kept = pairs.has(key)
    at, key = at[kept], key[kept]
    for size in range(3, longest + 1):
        on = at + size - 2 < len(codes)
        on[on] = linked[at[on] + size - 2]
        at, key = at[on], key[on]
        key = _joined(key, h[at + size - 1])
        yield size, at, key


class Summary:
    """Misra-Gries counters of each hash partition, as one sorted array; what was taken off a partition's counters stands in `lost`."""

    def __init__(self, parts: int, capacity: int):
        self.parts, self.capacity, self.lost = parts, capacity, {}
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct sorted keys with their counts; they wait until there are about as many as are held."""
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > max(WAITING, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate([own, *(w[n] for w in self.waiting)]) for n, own in enumerate((self.keys, self.counts)))
        self.waiting = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[:len(keys)]
        self.keys, self.counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(self.keys) <= self.capacity:
            return
        part = dealt(self.keys, self.parts)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        over = np.flatnonzero(np.diff(np.r_[cut, len(part)]) > self.capacity)
        for n in over.tolist():
            here = slice(int(cut[n]), int(cut[n + 1]) if n + 1 < len(cut) else len(part))
            least = int(np.partition(self.counts[here], -self.capacity - 1)[-self.capacity - 1])
            self.counts[here] -= least
            p = int(part[cut[n]])
            self.lost[p] = self.lost.get(p, 0) + least
        if len(over):
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]


class Counted:
    """Occurrences and text of phrases by key, as arrays; what was added waits until it is merged."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray, texts: pa.Array) -> None:
        if len(keys):
            self.parts.append((keys, counts, texts))

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.parts)

    def settle(self) -> None:
        if len(self.parts) > 1:
            keys, counts = (np.concatenate([p[n] for p in self.parts]) for n in (0, 1))
            order = np.argsort(keys, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
            self.parts = [(keys[order[at]], np.add.reduceat(counts[order], at), pa.concat_arrays([p[2] for p in self.parts]).take(pa.array(order[at])))]


def _texts(words: pa.Array, codes: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The runs of `size` words at the starts, joined by a blank."""
    return pc.binary_join_element_wise(*(words.take(pa.array(codes[starts + k] - 1)) for k in range(size)), " ")


def frequent(encoded: DataFrame, folder: str, words: KeySet, pairs: KeySet | None, mass: int, threshold: int, longest: int, capacity: int) -> DataFrame:
    """lang, phrase, size, key and a of every phrase (pairs, or longer runs) that occurs `threshold` times or more; `mass` bounds all occurrences."""
    spark, half = encoded.sparkSession, threshold // 2
    rows = encoded.select("codes", "hashes")

    def summaries(parts):
        def run(batches):
            held = Summary(parts, capacity)
            for batch in batches:
                for row in _rows(batch):
                    for _, _, key in phrases(row, words, pairs, longest):
                        held.add(*np.unique(key, return_counts=True))
            held.settle()
            for a in range(0, len(held.keys), OUT_ROWS):
                key, n = held.keys[a:a + OUT_ROWS].view(np.int64), held.counts[a:a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), -1, np.int32)), pa.array(key), pa.array(n)], ["part", "key", "n"])
            if held.lost:
                yield pa.RecordBatch.from_arrays([pa.array(list(held.lost), pa.int32()), pa.nulls(len(held.lost), pa.int64()), pa.array(list(held.lost.values()), pa.int64())], ["part", "key", "n"])
        return run

    parts, turn = pieces(SLACK * mass, threshold * capacity), 0
    while True:
        path = f"{folder}/merged-{turn}"
        merged = rows.mapInArrow(summaries(parts), "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
        merged.where(f"part >= 0 OR n >= {threshold - half}").write.parquet(path)
        merged = spark.read.parquet(path)
        loss = merged.where("part >= 0").agg(F.max("n").alias("n")).first()["n"] or 0
        if loss <= half:
            break
        parts, turn = parts * 2, turn + 1
    survivors = store_keys(merged.where(f"part < 0 AND n >= {threshold - loss}").select("key"), f"{folder}/survivors")

    def count(batches):
        held: dict[tuple[str, int], Counted] = {}

        def drained():
            for (lang, size), found in held.items():
                found.settle()
                for keys, counts, texts in found.parts:
                    for a in range(0, len(keys), OUT_ROWS):
                        here = slice(a, a + OUT_ROWS)
                        n = len(keys[here])
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), texts[here], pa.array(np.full(n, size, np.int32)), pa.array(keys[here].view(np.int64)),
                                                          pa.array(counts[here])], ["lang", "phrase", "size", "key", "a"])
            held.clear()
        for batch in batches:
            for row in _rows(batch):
                codes = None
                for size, at, key in phrases(row, words, pairs, longest):
                    on = survivors.has(key)
                    key, first, n = np.unique(key[on], return_index=True, return_counts=True)
                    codes = _codes(row["codes"]) if codes is None else codes
                    held.setdefault((row["lang"], size), Counted()).add(key, n, _texts(row["words"], codes, at[on][first], size))
                if sum(map(len, held.values())) > HELD:
                    for found in held.values():
                        found.settle()
                    if sum(map(len, held.values())) > HELD:
                        yield from drained()
        yield from drained()
    counted = encoded.select("lang", "codes", "words", "hashes").mapInArrow(count, "lang string, phrase string, size int, key long, a long")
    path = f"{folder}/counted"
    counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"), F.first("key").alias("key")).where(f"a >= {threshold}").write.parquet(path)
    return spark.read.parquet(path)


def _slice_of(start: str, length: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {start}, {length}), ' ')"


def scored(known: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases; `known` holds all frequent words and phrases (lang, phrase, size, a), totals (lang, n)."""
    wide = "DECIMAL(17,0)"      # counts stay below 10^17, so products of two of them and 1000 fit 38 digits
    cuts = known.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr(_slice_of("1", "k"))).withColumn("rest", F.expr(_slice_of("k + 1", "size - k")))
    part = known.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    for name, side in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(part, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).withColumnRenamed("f", name).drop("of", "part")
    cuts = cuts.join(totals, "lang")
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS {wide}) * CAST(n AS {wide})) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # Of two phrases, one inside the other and equally frequent, all between are as frequent: looking one word further is enough.
    longer = known.where("size > 2").select("lang", F.expr(f"explode(array({_slice_of('1', 'size - 1')}, {_slice_of('2', 'size - 1')}))").alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = best.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, capacity: int = CAPACITY) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language of docs (text, lang)."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "collocations")
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("octet_length(text) > 0")
    texts.mapInArrow(_encode, ENCODED).write.parquet(f"{folder}/codes")
    encoded = spark.read.parquet(f"{folder}/codes")
    totals = encoded.groupBy("lang").agg(F.sum("n_words").alias("n"))
    each = encoded.select("lang", F.explode(F.arrays_zip("words", "counts", "hashes")).alias("w")).select("lang", "w.words", "w.counts", "w.hashes")
    each.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("a"), F.first("hashes").alias("key")).where(f"a >= {threshold}") \
        .withColumn("size", F.lit(1)).write.parquet(f"{folder}/words")
    known = spark.read.parquet(f"{folder}/words")
    words = store_keys(known.select("key"), f"{folder}/word-keys")
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    pairs = frequent(encoded, f"{folder}/pairs", words, None, total, threshold, 2, capacity)
    known = known.unionByName(pairs)
    if longest > 2:
        mass = (longest - 2) * (pairs.agg(F.sum("a").alias("n")).first()["n"] or 0)
        runs = frequent(encoded, f"{folder}/runs", words, store_keys(pairs.select("key"), f"{folder}/pair-keys"), mass, threshold, longest, capacity)
        known = known.unionByName(runs)
    return scored(known.select("lang", "phrase", "size", "a"), totals, top)

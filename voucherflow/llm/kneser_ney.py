"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays that workers memory-map.

Tokens are words and one end for each text; the first token's context is a mark that is no token. The model is
    p(w | u) = max(c(u w) - D(c), 0) / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / c(u) * p(w)
    p(w)     = max(N(. w) - D'(N), 0) / N(. .) + (D1' n1 + D2' n2 + D3' n3+) / N(. .) / (V + 1)
with N(. w) the distinct contexts of w, Nk(u) the distinct words seen k times after u, and discounts from the counts of counts of either level
(modified as by Chen and Goodman). V + 1 counts one unknown word, so each p(. | u) sums to one.

Counting. Each task turns a piece of text into sorted distinct keys with counts, dealt to buckets by key; a bucket's task merges them and
writes one sorted array file into the shared run folder. Words come first: the key is the 64-bit hash, and a word's number is its
place among all sorted hashes. Pairs follow: the key is (context number, word number) in one long, dealt so that even a
very frequent context is cut into 16 or more pieces. Their tasks also send on each context's totals and each word's distinct contexts, which meet by ranges of word numbers. Files are written under
another name and moved, so a repeated task leaves the same file. Nothing but a few figures for each bucket reaches the driver.

Scoring reads each text once: words and pairs of a piece are made distinct and sorted, then found in the mapped arrays by binary search.

Rows: a null text counts as empty and is one end token; null, repeated ids and repeated rows are rows like any other; texts are
taken whole; an empty table gives no rows; with no training rows every known count is zero. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import coded_words, map_array, pack, pieces, run_folder, slices, unpack, write_array

SLICE = 8 << 20                 # bytes of text made into keys at once
WORD_BUCKET, PAIR_BUCKET = 48 << 20, 8 << 20    # bytes of text for one bucket
MOST_BUCKETS = 1 << 20          # then buckets grow instead
END = xxhash.xxh64_intdigest(b"\n", 42)         # a line feed is in no word
CONTEXT_CUTS = 16
STATS = (("total", np.uint64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32), ("contexts", np.uint32))


@dataclass
class Model:
    folder: str
    first: np.ndarray           # number of the first word of each word bucket; the last entry is V
    tokens: int
    pair_buckets: int
    wide: frozenset[int]        # pair buckets whose counts take 8 bytes
    pair_discounts: np.ndarray  # for counts 0, 1, 2, 3 and more
    word_discounts: np.ndarray
    pair_types: int
    rest: float                 # mass that the lower level gives to unknown and known words alike

    @property
    def vocabulary(self) -> int:
        return int(self.first[-1])


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a pair: by its context and four bits of its word."""
    x = (keys >> np.uint64(32)) * np.uint64(CONTEXT_CUTS) + (keys & np.uint64(CONTEXT_CUTS - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return _spread(x ^ (x >> np.uint64(29)), buckets)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with its sorted keys and their counts."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order].astype(np.uint64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[:len(bucket)]
    rows = [(int(bucket[a]), pack(keys[a:b]), pack(counts[a:b])) for a, b in zip(cut, np.r_[cut, len(keys)][1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                                      ["bucket", "keys", "counts"])


DEALT = "bucket int, keys binary, counts binary"


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(x, np.uint64) for x in group.column("keys").to_pylist()]
    counts = [unpack(x, np.uint64) for x in group.column("counts").to_pylist()]
    return _summed(np.concatenate(keys), np.concatenate(counts))


# ---- reading the arrays ----------------------------------------------------

_MAPPED: OrderedDict = OrderedDict()
MOST_MAPPED = 2_000             # arrays a worker process keeps mapped


def _array(folder: str, name: str, dtype) -> np.ndarray:
    key = (folder, name)
    if key not in _MAPPED:
        _MAPPED[key] = map_array(f"{folder}/{name}", dtype)
        if len(_MAPPED) > MOST_MAPPED:
            _MAPPED.popitem(last=False)
    _MAPPED.move_to_end(key)
    return _MAPPED[key]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _by_bucket(bucket: np.ndarray):
    """(bucket, members) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.empty(0, np.int64)
    for a, b in zip(cut, np.r_[cut, len(order)][1:], strict=True):
        yield int(sorted_[a]), order[a:b]


def word_numbers(folder: str, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word hash, -1 if it was not seen in training."""
    out = np.full(len(hashes), -1, np.int64)
    for bucket, members in _by_bucket(_spread(hashes, len(first) - 1)):
        if first[bucket + 1] > first[bucket]:
            members = members[np.argsort(hashes[members])]
            at = _find(_array(folder, f"word-{bucket}.key", np.uint64), hashes[members])
            out[members] = np.where(at < 0, -1, at + first[bucket])
    return out


def _word_values(folder: str, first: np.ndarray, numbers: np.ndarray, names) -> list[np.ndarray]:
    """Values of known words by number, zero for others; the mark before a text has the number V and a bucket of its own."""
    out = [np.zeros(len(numbers), np.float64) for _ in names]
    known = np.flatnonzero(numbers >= 0)
    bucket = np.searchsorted(first, numbers[known], side="right") - 1
    for b, members in _by_bucket(bucket):
        at = known[members]
        for o, (name, dtype) in zip(out, names, strict=True):
            o[at] = _array(folder, f"word-{b}.{name}", dtype)[numbers[at] - first[b]]
    return out


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Training count of each pair key."""
    out = np.zeros(len(keys), np.float64)
    for bucket, members in _by_bucket(_pair_bucket(keys, model.pair_buckets)):
        stored = _array(model.folder, f"pair-{bucket}.key", np.uint64)
        at = _find(stored, keys[members])
        hit = at >= 0
        if hit.any():
            counts = _array(model.folder, f"pair-{bucket}.count", np.uint64 if bucket in model.wide else np.uint32)
            out[members[hit]] = counts[at[hit]]
    return out


# ---- counting --------------------------------------------------------------

def _sequence(codes: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, end: int, begin: int):
    """Token and context numbers of all texts, each with its end, and where each text starts."""
    n_docs = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n_docs)
    tokens = np.empty(len(codes) + n_docs, np.int64)
    ends = offsets[1:] + np.arange(n_docs)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = numbers[codes], end
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts] = begin
    return tokens, context, starts


def _count_words(batches):
    for piece in slices(batches, "text", SLICE):
        codes, distinct, _ = coded_words(piece.column("text"))
        hashes = np.r_[word_hashes(distinct), np.uint64(END)]
        counts = np.r_[np.bincount(codes, minlength=len(distinct)), piece.num_rows].astype(np.uint64)
        keys, counts = _summed(hashes, counts)
        yield keys, counts


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of types seen 1, 2, 3 and 4 times.

    Where those are too few for the estimate, half of the count up to one and a half."""
    n1, n2, n3, n4 = (float(x) for x in n)
    out = [0.0, 0.5, 1.0, 1.5]
    if n1 > 0 and n2 > 0:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        if n3 > 0:
            out[2] = 2 - 3 * y * n3 / n2
            if n4 > 0:
                out[3] = 3 - 4 * y * n4 / n3
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(out[1:], 1))])


def _four(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def fit(docs: DataFrame) -> Model:
    """Count all rows of docs (text) and write the model's arrays into a run folder on shared storage."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    folder = run_folder(spark, "kneser-ney")
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    word_buckets, pair_buckets = (min(MOST_BUCKETS, pieces(size, each)) for each in (WORD_BUCKET, PAIR_BUCKET))

    def words(batches):
        for keys, counts in _count_words(batches):
            yield _dealt(keys, counts, _spread(keys, word_buckets))

    def merge_words(group):
        bucket = group.column("bucket")[0].as_py()
        keys, counts = _gathered(group)
        write_array(f"{folder}/word-{bucket}.key", keys)
        write_array(f"{folder}/word-{bucket}.count", counts)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    got = texts.mapInArrow(words, DEALT).groupBy("bucket").applyInArrow(merge_words, "bucket int, n long, tokens long").collect()
    per = np.zeros(word_buckets, np.int64)
    for r in got:
        per[r["bucket"]] = r["n"]
    first = np.r_[0, np.cumsum(per)]
    if first[-1] >= (1 << 32) - 1:
        raise ValueError("over 4 billion distinct words: a pair of word numbers no longer fits one long")
    begin = int(first[-1])

    def pairs(batches):
        for piece in slices(batches, "text", SLICE):
            codes, distinct, offsets = coded_words(piece.column("text"))
            numbers = word_numbers(folder, first, np.r_[word_hashes(distinct), np.uint64(END)])
            tokens, context, _ = _sequence(codes, offsets, numbers, int(numbers[-1]), begin)
            keys, counts = np.unique((context.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64), return_counts=True)
            yield _dealt(keys, counts, _pair_bucket(keys, pair_buckets))

    def merge_pairs(group):
        bucket = group.column("bucket")[0].as_py()
        keys, counts = _gathered(group)
        wide = bool(counts.max() >= 1 << 32)
        write_array(f"{folder}/pair-{bucket}.key", keys)
        write_array(f"{folder}/pair-{bucket}.count", counts if wide else counts.astype(np.uint32))
        context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        u = context[at]
        sums = [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        v, n_contexts = np.unique(word, return_counts=True)
        rows = []
        u_bucket, v_bucket = (np.searchsorted(first, x.astype(np.int64), side="right") - 1 for x in (u, v))
        for b in np.union1d(u_bucket, v_bucket).tolist():
            ua, ub = np.searchsorted(u_bucket, [b, b + 1])
            va, vb = np.searchsorted(v_bucket, [b, b + 1])
            rows.append((b, pack(u[ua:ub]), pack(np.concatenate([s[ua:ub] for s in sums])), pack(v[va:vb]), pack(n_contexts[va:vb].astype(np.uint64))))
        four = [_four(counts)] + [[0] * 4] * (len(rows) - 1)
        wides = [[bucket] if wide else []] + [[]] * (len(rows) - 1)
        return pa.table({"word_bucket": pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(("u", "sums", "v", "contexts"), 1)},
                         "four": pa.array(four, pa.list_(pa.int64())), "wide": pa.array(wides, pa.list_(pa.int32()))})

    def merge_stats(group):
        b = group.column("word_bucket")[0].as_py()
        base = int(first[b])
        n = int(first[b + 1]) - base if b + 1 < len(first) else 1
        out = {name: np.zeros(n, np.uint64) for name, _ in STATS}
        for u, sums, v, contexts in zip(*(group.column(c).to_pylist() for c in ("u", "sums", "v", "contexts")), strict=True):
            at = unpack(u, np.uint64).astype(np.int64) - base
            for (name, _), part in zip(STATS, unpack(sums, np.uint64).reshape(4, -1), strict=False):
                out[name][at] += part
            out["contexts"][unpack(v, np.uint64).astype(np.int64) - base] += unpack(contexts, np.uint64)
        for name, dtype in STATS:
            write_array(f"{folder}/word-{b}.{name}", out[name].astype(dtype))
        seen = out["contexts"]
        three = int((seen >= 3).sum())
        return pa.table({"four": pa.array([np.sum(group.column("four").to_pylist(), axis=0).tolist()], pa.list_(pa.int64())),
                         "wide": pa.array([sum(group.column("wide").to_pylist(), [])], pa.list_(pa.int32())),
                         "word_four": pa.array([_four(seen)], pa.list_(pa.int64())), "three": pa.array([three], pa.int64()), "types": pa.array([int(seen.sum())], pa.int64())})

    merged = texts.mapInArrow(pairs, DEALT).groupBy("bucket").applyInArrow(
        merge_pairs, "word_bucket int, u binary, sums binary, v binary, contexts binary, four array<long>, wide array<int>")
    stats = merged.groupBy("word_bucket").applyInArrow(merge_stats, "four array<long>, wide array<int>, word_four array<long>, three long, types long").collect()
    pair_d = discounts(np.sum([r["four"] for r in stats] or [[0] * 4], axis=0))
    word_four = np.sum([r["word_four"] for r in stats] or [[0] * 4], axis=0)
    word_d = discounts(word_four)
    types, three = sum(r["types"] for r in stats), sum(r["three"] for r in stats)
    rest = (word_d[1] * word_four[0] + word_d[2] * word_four[1] + word_d[3] * three) / types if types else 1.0
    return Model(folder, first, sum(r["tokens"] for r in got), pair_buckets, frozenset(b for r in stats for b in r["wide"]), pair_d, word_d, types, float(rest))


# ---- scoring ---------------------------------------------------------------

def score_texts(model: Model, texts: pa.Array):
    """n_tokens, n_known, base_score and score of each text."""
    codes, distinct, offsets = coded_words(texts)
    hashes = np.r_[word_hashes(distinct), np.uint64(END)]
    numbers = word_numbers(model.folder, model.first, hashes)
    begin = model.vocabulary
    slots = len(numbers)                                       # words of this piece, its end, then the mark before texts
    ids = np.r_[numbers, begin if model.tokens else -1]
    count, = _word_values(model.folder, model.first, numbers, (("count", np.uint64),))
    total, n1, n2, n3, contexts = _word_values(model.folder, model.first, ids, STATS)
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
    d = model.word_discounts[np.minimum(contexts, 3).astype(np.int64)]
    unigram = model.rest / (model.vocabulary + 1) + np.maximum(contexts - d, 0) / max(1, model.pair_types)
    p = model.pair_discounts
    safe = np.maximum(total, 1)
    back = np.where(total > 0, (p[1] * n1 + p[2] * n2 + p[3] * n3) / safe, 1.0)
    tokens, context, starts = _sequence(codes, offsets, np.arange(slots), slots - 1, slots)
    probability = back[context] * unigram[tokens]
    both = np.flatnonzero((ids[context] >= 0) & (ids[tokens] >= 0))
    if len(both):
        keys = (ids[context[both]].astype(np.uint64) << np.uint64(32)) | ids[tokens[both]].astype(np.uint64)
        distinct_keys, which = np.unique(keys, return_inverse=True)
        seen = pair_counts(model, distinct_keys)
        direct = np.maximum(seen - p[np.minimum(seen, 3).astype(np.int64)], 0)[which]
        probability[both] += direct / safe[context[both]]
    sums = [np.add.reduceat(x, starts) if len(starts) else np.empty(0) for x in (base[tokens], np.log10(probability), (count[tokens] > 0).astype(np.int64))]
    return np.diff(offsets) + 1, sums[2].astype(np.int64), sums[0], sums[1]


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's token counts, unigram base score, model score (log10) and perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in slices(batches, "text", SLICE):
            n, known, base, value = score_texts(shared.value, piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), shared.value.tokens, np.int64)),
                                              pa.array(base), pa.array(value), pa.array(10 ** (-value / n))],
                                             ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCORED)

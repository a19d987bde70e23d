"""Benchmark passages in documents by latent semantic retrieval, with subsequence and answer checks.

Terms are the distinct words (letters only, lower case) of the benchmark, so a document word that is no term can neither match nor weigh
anything. One pass over the texts keeps each document's terms with their places, packed; all later passes read only that.
Texts are read in blocks of `BLOCK` words, and a passage is two neighbouring blocks, so any run of up to BLOCK words lies whole in a
passage. Benchmark items are cut into passages of up to BLOCK words, half overlapping.

TF-IDF uses document frequencies over all blocks of all documents; a term in over `STOP_SHARE` of the blocks weighs nothing, unless its
item would keep fewer than MIN_TERMS weighted terms. The right singular vectors of the matrix of all document blocks and the benchmark passages (weighted to
carry as much energy as the documents) come from a randomised SVD in one pass: one product of the matrix and its transpose with a random start, summed over
partitions, and small decompositions on the driver. There is a direction for each benchmark passage of a group, up to RANK, so short items are not lost among
many. Pairs of a document passage and a benchmark passage that share enough weighted terms to pass the checks at all are candidates if their cosine in that space is
`COSINE` or more; beside it, if the document passage holds all of the RAREST rarest weighted terms of the benchmark passage, which every verbatim copy does,
whatever its length and the number of items. A candidate is confirmed by the longest common subsequence of words: a share of the
benchmark passage of `COPY` or more is a copy; from `PARAPHRASE` up it counts if `ANSWER` of the item's answer is there in order too, the answer being its last
sentence (its last ANSWER_WORDS words if that is longer). Either way the subsequence must hold MIN_TERMS weighted terms, or all the item has.

Texts are read once for each `PACKED_ITEMS` items, whose terms are packed together; the items are then taken in groups of `ITEMS`, each with its own terms and
vectors, so what is held and broadcast is bounded whatever the size of the benchmark.

Rows: null, empty and letterless texts or items match nothing; repeated items are found each; null or repeated doc_ids are rows like any
other, one result row for each document row and item; an empty table on either side gives no rows; texts are taken whole. Only
doc_id, text and item_id, text are read, so further columns cannot clash.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import checkpoint, pack, pieces, slices, unpack
from voucherflow.llm.language import letter_words

BLOCK = 48
STOP_SHARE = 0.02
MIN_TERMS = 3
RANK, MORE = 288, 32            # most singular vectors kept, and further columns of the random start
COSINE = 0.25
RAREST = 4
COPY, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.75, 0.5, 0.7, 12
ITEMS, PACKED_ITEMS = 256, 10_000
TERM_CHUNK = 512
COUNTED = 1 << 21       # pairs of a document passage and a benchmark passage whose shared words are counted at a time
SLICE = 4 << 20         # bytes of text packed together
GATHER = 1 << 14        # table rows summed at a time


@dataclass
class Items:
    """Benchmark passages of one group as term numbers."""
    ids: list                                   # item_id of each passage
    passages: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)

    def narrowed(self, first: int, last: int) -> tuple["Items", np.ndarray]:
        """The passages from `first` up to `last` with terms numbered among themselves, and the term that each number stands for."""
        own, index = np.unique(np.concatenate([*self.passages[first:last], *self.answers[first:last]]), return_inverse=True)
        sizes = [len(x) for x in (*self.passages[first:last], *self.answers[first:last])]
        parts = np.split(index, np.cumsum(sizes)[:-1])
        n = last - first
        return Items(self.ids[first:last], parts[:n], parts[n:]), own


def _words(text: str) -> list[str]:
    codes, distinct, _ = letter_words(pa.array([text], pa.string()))
    return [distinct[c] for c in codes.tolist()]


def prepare(rows: list[tuple]) -> Items:
    """Passages and answers of (item_id, text) rows; the longest whole passages, half overlapping, and one that ends the item."""
    out = Items([])
    for item, text in rows:
        words = _words(text or "")
        if not words:
            continue
        sentences = [w for w in map(_words, re.split(r"[.!?\n]+", text)) if w]
        answer = sentences[-1] if len(sentences[-1]) <= ANSWER_WORDS else words[-ANSWER_WORDS:]
        numbers = np.array([out.terms.setdefault(w, len(out.terms)) for w in words], np.int64)
        starts = sorted({*range(0, max(1, len(words) - BLOCK + 1), BLOCK // 2), max(0, len(words) - BLOCK)})
        for a in starts:
            out.ids.append(item), out.passages.append(numbers[a:a + BLOCK])
            out.answers.append(np.array([out.terms[w] for w in answer], np.int64))
    return out


# ---- packed terms of the documents -----------------------------------------

PACKED = "doc_ids array<long>, words binary, terms binary, places binary"


def packed_terms(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """One row for each piece of a partition: doc ids, where each document's words end, and the terms with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shared.value
        for piece in slices(batches, "text", SLICE):
            codes, distinct, offsets = letter_words(piece.column("text"))
            number = np.fromiter((known.get(w, -1) for w in distinct), np.int64, len(distinct))
            at = number[codes] if len(codes) else np.empty(0, np.int64)
            places = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([pack(offsets.astype(np.uint64))], pa.binary()),
                 pa.array([pack(at[places].astype(np.uint32))], pa.binary()), pa.array([pack(places.astype(np.uint64))], pa.binary())],
                ["doc_ids", "words", "terms", "places"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


@dataclass
class Piece:
    doc_ids: list
    terms: np.ndarray
    doc: np.ndarray         # document of each term
    block: np.ndarray       # its block; blocks of different documents are never neighbours
    place: np.ndarray       # its word number in the document
    blocks: int


def _piece(doc_ids, words, terms, places) -> Piece:
    offsets = unpack(words, np.uint64).astype(np.int64)
    at, number = unpack(places, np.uint64).astype(np.int64), unpack(terms, np.uint32).astype(np.int64)
    count = -(-np.diff(offsets) // BLOCK)
    first = np.r_[0, np.cumsum(count + 1)]
    doc = np.searchsorted(offsets, at, side="right") - 1
    place = at - offsets[doc]
    return Piece(doc_ids, number, doc, first[doc] + place // BLOCK, place, int(count.sum()))


def _pieces(batches, own: np.ndarray | None = None):
    """The packed pieces; with `own` only those terms, by their places in it."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "words", "terms", "places")), strict=True):
            p = _piece(*row)
            if own is not None:
                at = np.minimum(np.searchsorted(own, p.terms), len(own) - 1)
                keep = own[at] == p.terms
                p.terms, p.doc, p.block, p.place = at[keep], p.doc[keep], p.block[keep], p.place[keep]
            yield p


def frequencies(packed: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Blocks that hold each term, and the number of blocks."""
    def run(batches):
        total, blocks = np.zeros(n_terms, np.int64), 0
        for p in _pieces(batches):
            pair = np.unique(p.block * n_terms + p.terms)
            total += np.bincount(pair % n_terms, minlength=n_terms)
            blocks += p.blocks
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(n_terms), -1]), pa.array(np.r_[total, blocks])], ["term", "n"])
    got = packed.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def weights(items: Items, df: np.ndarray, blocks: int) -> np.ndarray:
    idf = np.log((1 + blocks) / (1 + df))
    stop = df > STOP_SHARE * max(1, blocks)
    keep = ~stop
    for passage in items.passages:
        distinct = np.unique(passage)
        if keep[distinct].sum() < min(MIN_TERMS, len(distinct)):
            keep[distinct[np.argsort(df[distinct], kind="stable")[:MIN_TERMS]]] = True
    return np.where(keep, np.maximum(idf, 1e-3), 0.0)


def _rows(terms: np.ndarray, row: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows by row, about GATHER of them at a time; `row` is sorted."""
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    out = np.empty((len(at), table.shape[1]), table.dtype)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(at, at[first] + GATHER)))
        end = at[last] if last < len(at) else len(row)
        out[first:last] = np.add.reduceat(table[terms[at[first]:end]], at[first:last] - at[first], axis=0)
        first = last
    return row[at], out


def _gram(terms, row, weighted, weight) -> np.ndarray:
    """A' (A basis) for the rows of tf-idf weights that (terms, row) stand for; `weighted` is the basis with each term's row times its weight."""
    _, y = _rows(terms, row, weighted)
    at = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
    order = np.argsort(terms, kind="stable")
    found, sums = _rows(at[order], terms[order], y)
    out = np.zeros(weighted.shape, weighted.dtype)
    out[found] = weight[found, None] * sums
    return out


def _corpus_gram(packed: DataFrame, own: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    n_terms, width = basis.shape
    shared = packed.sparkSession.sparkContext.broadcast(((weight[:, None] * basis).astype(np.float32), own))

    def run(batches):
        table, own = shared.value
        total = np.zeros((n_terms, width), np.float32)
        for p in _pieces(batches, own):
            keep = weight[p.terms] > 0
            if keep.any():
                total += _gram(p.terms[keep], p.block[keep], table, weight)
        chunks = [(k, total[a:a + TERM_CHUNK].tobytes()) for k, a in enumerate(range(0, n_terms, TERM_CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.binary())], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = 0.0, None
        for batch in batches:
            chunk = batch.column("chunk").slice(0, 1)
            for blob in batch.column("sums"):
                total = total + np.frombuffer(blob.as_py(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([chunk, pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    out = np.zeros_like(basis)
    # Each task sends one dense sum, so there are as many as the cluster runs at once twice over, however large the input.
    few = packed.coalesce(2 * packed.sparkSession.sparkContext.defaultParallelism)
    for r in few.mapInArrow(run, "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect():
        part = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
        out[r["chunk"] * TERM_CHUNK:r["chunk"] * TERM_CHUNK + len(part)] = part
    shared.unpersist()
    return out


def latent_basis(packed: DataFrame, items: Items, own: np.ndarray, weight: np.ndarray, rank: int = RANK, more: int = MORE) -> np.ndarray:
    """Leading right singular vectors (terms, one for each passage up to `rank`) of document blocks and benchmark passages together, from one product."""
    n_terms = len(weight)
    rank = min(rank, len(items.passages))
    width = min(rank + more, n_terms)
    own_terms = np.concatenate(items.passages)
    own_row = np.repeat(np.arange(len(items.passages)), [len(p) for p in items.passages])
    keep = weight[own_terms] > 0
    own_terms, own_row = own_terms[keep], own_row[keep]
    start = np.linalg.qr(np.random.default_rng(3).normal(size=(n_terms, width)))[0]
    corpus, mine = _corpus_gram(packed, own, weight, start), _gram(own_terms, own_row, weight[:, None] * start, weight)
    # The trace of start' G start is the energy that each side shows in the random start.
    seen, shown = float(np.sum(start * corpus)), float(np.sum(start * mine))
    both = corpus + (max(1.0, seen / shown) if shown > 0 else 1.0) * mine
    # G is close to Y (start' Y)^-1 Y' with Y = G start, whose root has G's singular vectors.
    core = start.T @ both
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-9 * max(value.max(), 1e-30)
    left, size, _ = np.linalg.svd(both @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return left[:, :rank][:, size[:rank] > 1e-6 * max(size.max(initial=0.0), 1e-30)]


# ---- candidates and checks -------------------------------------------------

def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict[int, int] = {}
    for n, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | (1 << n)
    full = (1 << len(b)) - 1
    v = full
    for x in a.tolist():
        u = v & where.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


MATCHES = "doc_id long, item_id long, start_word long, cosine double, lcs_share double, answer_share double, kind string"


class Counts:
    """How many words of each list (of terms) are among given terms, counted over an inverted index."""

    def __init__(self, lists: list[np.ndarray], n_terms: int):
        term = np.concatenate(lists) if lists else np.empty(0, np.int64)
        which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(term, kind="stable")
        self.which = which[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def __call__(self, row: np.ndarray, term: np.ndarray, rows: int, lists: int) -> np.ndarray:
        """(rows, lists) from distinct pairs (row, term)."""
        n = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(row, n) * lists + self.which[at], minlength=rows * lists).reshape(rows, lists)


def _candidates(row, term, rows, at, places, counts, need, rarest, projected, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, passage, cosine) of the candidates among windows 0 to `rows`; (row, term) are their distinct terms, (at, places) all of them in order."""
    heavy, rare = counts
    i, k = np.nonzero(heavy(row, term, rows, len(need)) >= need)       # weighted terms are rare, so few pairs go on
    used, which = np.unique(i, return_inverse=True)
    some = np.isin(at, used)
    vector = np.zeros((len(used), projected.shape[1]), np.float32)
    found, sums = _rows(places[some], np.searchsorted(used, at[some]), projected)
    vector[found] = sums
    length = np.maximum(np.linalg.norm(vector, axis=1), 1e-12)
    cosine = np.einsum("nd,nd->n", vector[which], own[k]) / length[which]
    some = np.isin(row, used)
    whole = rare(np.searchsorted(used, row[some]), term[some], len(used), len(need))[which, k] == rarest[k]
    good = (cosine >= COSINE) | whole
    return i[good], k[good], cosine[good]


def search(packed: DataFrame, items: Items, own_terms: np.ndarray, weight: np.ndarray, basis: np.ndarray, df: np.ndarray) -> DataFrame:
    """Confirmed matches: the best passage for each document row and item."""
    projected = (weight[:, None] * basis).astype(np.float32)
    own = np.stack([projected[p].sum(axis=0) for p in items.passages])
    own = own / np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    heavy = [p[weight[p] > 0] for p in items.passages]
    need = np.array([min(MIN_TERMS, len(h)) if len(h) else 1 for h in heavy])
    rare = [(u := np.unique(h))[np.argsort(df[u], kind="stable")[:RAREST]] for h in heavy]
    counts = tuple(Counts(x, len(weight)) for x in (heavy, rare))
    rarest = np.array([len(x) for x in rare])
    shared = packed.sparkSession.sparkContext.broadcast((projected, own, own_terms, weight, items.ids, items.passages, items.answers, heavy, counts, need, rarest))

    def run(batches):
        projected, own, own_terms, weight, ids, passages, answers, heavy, counts, need, rarest = shared.value
        n_terms, step = len(weight), max(1, COUNTED // len(passages))
        for p in _pieces(batches, own_terms):
            best: dict[tuple[int, int], tuple] = {}
            block = np.unique(p.block)
            next_ = np.r_[block[1:] == block[:-1] + 1, False][:len(block)]
            first = np.searchsorted(p.block, block)
            last = np.searchsorted(p.block, block + next_, side="right")
            for at in range(0, len(block), step):
                n = last[at:at + step] - first[at:at + step]
                inside = np.repeat(first[at:at + step] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                window, term = np.repeat(np.arange(len(n)), n), p.terms[inside]
                pair = np.unique(window * n_terms + term)
                for i, k, cosine in zip(*_candidates(pair // n_terms, pair % n_terms, len(n), window, term, counts, need, rarest, projected, own), strict=True):
                    a, b = int(first[at + i]), int(last[at + i])
                    found = _check(p.terms[a:b], weight, passages[k], answers[k], heavy[k], int(need[k]))
                    if found:
                        key = (int(p.doc[a]), ids[k])
                        if key not in best or found[0] > best[key][0]:
                            best[key] = (found[0], found[1], float(cosine), int(p.place[a]), found[2])
            out = [(p.doc_ids[d], item, r[3], r[2], r[0], r[1], r[4]) for (d, item), r in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in MATCHES.split(", ")])
    return packed.mapInArrow(run, MATCHES)


def _check(window, weight, passage, answer, heavy, need):
    """(share of the passage, share of the answer, kind) of a confirmed candidate."""
    inner = window[weight[window] > 0]
    if not len(heavy) or lcs(inner, heavy) < need:
        return None
    share = lcs(window, passage) / len(passage)
    if share < PARAPHRASE:
        return None
    told = lcs(window, answer) / len(answer)
    if share >= COPY:
        return share, told, "copy"
    return (share, told, "paraphrase") if told >= ANSWER else None


def matches(docs: DataFrame, benchmark: DataFrame, group_items: int = ITEMS, packed_items: int = PACKED_ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, cosine, lcs_share, answer_share, kind (copy or paraphrase) of each document row and item that it holds."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    packs = pieces(rows.count(), packed_items)
    out = spark.createDataFrame([], MATCHES)
    for g in range(packs):
        part = rows if packs == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(packs)) == g)
        texts = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str)
        every = prepare(texts)
        if not every.ids:
            continue
        packed = checkpoint(packed_terms(docs, every.terms))
        df, blocks = frequencies(packed, len(every.terms))
        first = 0
        while first < len(every.ids):
            last = _group_end(every.ids, first, group_items)
            items, own = every.narrowed(first, last)
            weight = weights(items, df[own], blocks)
            out = out.unionByName(search(packed, items, own, weight, latent_basis(packed, items, own, weight), df[own]))
            first = last
    return out


def _group_end(ids: list, first: int, items: int) -> int:
    """Where the passages of `items` items from `first` on end; an item's passages stand together."""
    seen, last = 0, first
    while last < len(ids) and (seen < items or ids[last] == ids[last - 1]):
        seen += last == first or ids[last] != ids[last - 1]
        last += 1
    return last

"""Language of each word and of each text by a linear-chain conditional random field.

Labels are the languages that occur in the labelled rows. A word's features are its character n-grams of one to four, with marks at both ends,
so that those at an end are its affixes; the word itself; and its entries in lexicons, the words that are common and keep to one
language in the training sample. Transitions between the labels of neighbouring words are learned with the feature weights, on word windows
of labelled texts half of which are spliced from two languages, so the field labels code-switched text. Marginals come
from forward-backward over the whole sequence of a text. The language of a text is the label with the largest mean marginal, and that mean
is its score.

Training runs on the driver on a bounded sample: about `docs_per_lang` texts of each language, chosen by a hash, and of each at most
`windows` windows of `window_words` words spread over the whole text. Prediction reads every word of every text; emissions are computed once
for each distinct word of a piece of a batch, and forward-backward runs over chunks of all its texts at once, joined by their exact
transfer matrices, so a very long text costs no more a word than a short one.

Rows: a null text, or one without a letter, gets `und` and score 0; so does every text if no labelled row is there to learn from. Words
without a letter are skipped. Null or repeated ids, repeated rows and an empty table need no care: a row gives a row. Ties go to the first
label in order. Only doc_id, text and, for training rows, lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import coded_words, slices

UNKNOWN = "und"
BITS = 18               # feature weights are hashed to 2 ** BITS rows
GRAMS = 4
CHUNK = 32              # words between two joints of forward-backward
RESCALE = 4             # words between two rescalings of the messages
FIRST, LAST = 2, 3      # marks before and after a word


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray     # (labels, 2 ** BITS + lexicons)
    transition: np.ndarray  # (labels, labels)
    start: np.ndarray
    lexicon: dict[str, int]


# ---- features --------------------------------------------------------------

def letter_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-case words of the texts without the characters that are no letters: codes, distinct words, where each text starts.

    A word that has no letter is gone."""
    only = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\s]+", "")
    codes, distinct, offsets = coded_words(only)
    return codes, distinct.to_pylist(), offsets


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of all words of letters, one pair each."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = chr(FIRST) + f"{chr(LAST)}{chr(FIRST)}".join(words) + chr(LAST)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = codes == FIRST
    word = np.cumsum(starts, dtype=np.int32) - 1
    found_w, found_f = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = word[:len(h)] == word[n - 1:n - 1 + len(h)]
        if n == 1:
            inside &= codes > LAST
        found_w.append(word[:len(h)][inside]), found_f.append(_bucket(h[inside], n))
    first = np.flatnonzero(starts)
    place = np.arange(len(codes)) - first[word]
    mixed = codes * (np.uint64(0x9E3779B97F4A7C15) * (2 * np.minimum(place, 255).astype(np.uint64) + np.uint64(1)))
    found_w.append(np.arange(len(words), dtype=np.int32)), found_f.append(_bucket(np.add.reduceat(mixed, first), 9))
    return np.concatenate(found_w), np.concatenate(found_f)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    x = (h + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _with_lexicon(words: list[str], lexicon: dict[str, int]):
    word, feature = features(words)
    hits = [(n, lexicon[w]) for n, w in enumerate(words) if w in lexicon]
    if hits:
        more = np.array(hits, np.int64)
        word, feature = np.r_[word, more[:, 0]], np.r_[feature, (1 << BITS) + more[:, 1]]
    return word, feature


def emissions(field: Field, words: list[str]) -> np.ndarray:
    """Log scores (word, label)."""
    word, feature = _with_lexicon(words, field.lexicon)
    return np.stack([np.bincount(word, weights=field.weights[k][feature], minlength=len(words)) for k in range(len(field.labels))], axis=1).astype(np.float32)


# ---- training --------------------------------------------------------------

def _forward_backward(e: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Marginals, expected transitions and log likelihood scale for padded sequences e (sequence, place, label) of log scores."""
    top = e.max(axis=2, keepdims=True)
    x, a = np.exp(e - top), np.exp(transition)
    n, steps, labels = e.shape
    alpha, scale = np.zeros_like(x), np.zeros((n, steps))
    now = np.exp(start)[None, :] * x[:, 0]
    for t in range(steps):
        if t:
            step = (now @ a) * x[:, t]
            now = np.where(mask[:, t, None], step, now)
        scale[:, t] = now.sum(axis=1)
        now = now / scale[:, t, None]
        alpha[:, t] = now
    beta, pairs = np.ones((n, labels)), np.zeros((labels, labels))
    marginal = np.zeros_like(x)
    for t in range(steps - 1, -1, -1):
        m = alpha[:, t] * beta
        marginal[:, t] = m / m.sum(axis=1, keepdims=True) * mask[:, t, None]
        if t:
            back = x[:, t] * beta
            joint = alpha[:, t - 1, :, None] * a[None] * back[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * mask[:, t, None, None]).sum(axis=0)
            step = back @ a.T
            step /= step.sum(axis=1, keepdims=True)
            beta = np.where(mask[:, t, None], step, beta)
    return marginal, pairs


def train(windows: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.15, l2: float = 2e-4, seed: int = 11) -> Field | None:
    """Fit a field to (language, words) windows; every other sequence joins two windows, mostly of different languages."""
    labels = sorted({lang for lang, _ in windows})
    if not labels:
        return None
    number = {lang: n for n, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    other = rng.permutation(len(windows))
    words: dict[str, int] = {}
    coded = [(number[lang], [words.setdefault(w, len(words)) for w in ws]) for lang, ws in windows]
    sequences = []
    for n, (i, j) in enumerate(zip(order, other, strict=True)):
        (a, x), (b, y) = coded[i], coded[j]
        pairs = [(w, a) for w in x] if n % 2 else [(w, a) for w in x[:max(1, len(x) // 2)]] + [(w, b) for w in y[len(y) // 2:]]
        if pairs:
            sequences.append(pairs)
    if not sequences:
        return None
    vocabulary = list(words)
    counts = np.zeros((len(vocabulary), len(labels)))
    for lang, ws in coded:
        np.add.at(counts, (ws, lang), 1)
    # A lexicon entry is common and keeps to one language; one feature for each language's lexicon.
    common = (counts.sum(1) >= 4) & (counts.max(1) >= 0.9 * counts.sum(1))
    lexicon = {vocabulary[n]: int(counts[n].argmax()) for n in np.flatnonzero(common)}
    word, feature = _with_lexicon(vocabulary, lexicon)
    used, feature = np.unique(feature, return_inverse=True)
    size, longest = len(labels), max(map(len, sequences))
    at = np.zeros((len(sequences), longest), np.int64)
    gold = np.zeros((len(sequences), longest), np.int64)
    mask = np.zeros((len(sequences), longest), bool)
    for n, pairs in enumerate(sequences):
        at[n, :len(pairs)], gold[n, :len(pairs)], mask[n, :len(pairs)] = [p[0] for p in pairs], [p[1] for p in pairs], True
    hot = np.eye(size)[gold] * mask[:, :, None]
    seen_pairs = np.zeros((size, size))
    np.add.at(seen_pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    params = [np.zeros((len(used), size)), np.zeros((size, size)), np.zeros(size)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = mask.sum()
    for step in range(1, rounds + 1):
        w, transition, start = params
        emission = np.stack([np.bincount(word, weights=w[feature, k], minlength=len(vocabulary)) for k in range(size)], axis=1)
        marginal, pairs = _forward_backward(emission[at], mask, transition, start)
        off = (hot - marginal).reshape(-1, size)
        by_word = np.stack([np.bincount(at.ravel(), weights=off[:, k], minlength=len(vocabulary)) for k in range(size)], axis=1)
        gradient = [np.stack([np.bincount(feature, weights=by_word[word, k], minlength=len(used)) for k in range(size)], axis=1) / total,
                    (seen_pairs - pairs) / total, (hot[:, 0] - marginal[:, 0]).sum(axis=0) / total]
        for k, (p, g) in enumerate(zip(params, gradient, strict=True)):
            g = g - l2 * p / max(1, len(used) / 1000)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros((size, (1 << BITS) + size), np.float32)
    weights[:, used] = params[0].T
    return Field(labels, weights, params[1].astype(np.float32), params[2].astype(np.float32), lexicon)


def sample_windows(labelled: DataFrame, docs_per_lang: int = 600, windows: int = 4, window_words: int = 24) -> list[tuple[str, list[str]]]:
    """Word windows of a bounded sample of rows (lang, text, doc_id) for training."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(unit * min(1.0, docs_per_lang / n)))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(unit)) < share[F.col("lang")])

    def cut(batches):
        for piece in slices(batches, "text"):
            out = []
            codes, distinct, offsets = letter_words(piece.column("text"))
            distinct = np.array(distinct, object)
            for lang, a0, b0 in zip(piece.column("lang").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                w = distinct[codes[a0:b0]].tolist()
                last = max(0, len(w) - window_words)
                for a in sorted({round(last * k / max(1, windows - 1)) for k in range(windows)}):
                    if w[a:a + window_words]:
                        out.append((lang, w[a:a + window_words]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))], ["lang", "words"])
    got = drawn.select("lang", "text").mapInArrow(cut, "lang string, words array<string>").toArrow()
    return sorted(zip(got["lang"].to_pylist(), got["words"].to_pylist(), strict=True))


# ---- prediction ------------------------------------------------------------

def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (rows @ np.ones(rows.shape[1], rows.dtype))[:, None]


def marginals(field: Field, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact label marginals (word, label) of texts whose words' log scores stand one after the other in e."""
    labels, n_words = len(field.labels), len(e)
    x = np.ones((n_words + 1, labels), np.float32)
    x[:-1] = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(field.transition - field.transition.max()).astype(np.float32)
    begin = np.exp(field.start - field.start.max()).astype(np.float32)
    length = np.diff(offsets)
    docs = np.flatnonzero(length)
    chunks = -(-length[docs] // CHUNK)
    first = np.cumsum(chunks) - chunks                  # first chunk of each text
    total = int(chunks.sum())
    rank = np.arange(total) - np.repeat(first, chunks)
    at = (np.repeat(offsets[:-1][docs], chunks) + rank * CHUNK)[:, None] + np.arange(CHUNK)
    real = at < np.repeat(offsets[1:][docs], chunks)[:, None]
    at = np.where(real, at, n_words)
    last = np.zeros(total, bool)
    last[first + chunks - 1] = True
    x = x[at.T]                                          # (place, chunk, label)
    real = real.T
    # What a whole chunk does to the message that enters it.
    through = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    inner = np.flatnonzero(~last)
    m = through[inner]
    for t in range(CHUNK):
        m = (m * x[t, inner][:, None, :]) @ a
        if t % RESCALE == RESCALE - 1:
            m /= m.max(axis=(1, 2), keepdims=True)
    through[inner] = m
    enter = np.empty((total, labels), np.float32)
    enter[first] = begin
    for r in range(int(chunks.max()) - 1 if len(chunks) else 0):
        c = first[chunks > r + 1] + r
        g = np.einsum("cl,clm->cm", enter[c], through[c])
        enter[c + 1] = g / g.sum(axis=1, keepdims=True)
    alpha = np.empty((CHUNK, total, labels), np.float32)
    now = enter
    for t in range(CHUNK):
        now = (now if t == 0 else now @ a) * x[t]
        if t % RESCALE == RESCALE - 1:
            now = _unit(now)
        alpha[t] = now
    # Messages from the right: into each text's last chunk, then through the others.
    left = np.ones((total, labels), np.float32)
    ends = np.flatnonzero(last)
    b = np.ones((len(ends), labels), np.float32)
    for t in range(CHUNK - 1, -1, -1):
        b = np.where(real[t, ends][:, None], x[t, ends] * b, b)
        if t:
            b = np.where(real[t, ends][:, None], b @ a.T, b)
        b = b / b.sum(axis=1, keepdims=True)
    left[ends] = b
    for r in range(int(chunks.max()) - 2 if len(chunks) else -1, -1, -1):
        c = first[chunks > r + 1] + r
        g = np.einsum("clm,cm->cl", through[c], left[c + 1])
        left[c] = g / g.sum(axis=1, keepdims=True)
    back = np.ones((total, labels), np.float32)
    back[inner] = left[inner + 1] @ a.T
    out = np.empty((n_words, labels), np.float32)
    for t in range(CHUNK - 1, -1, -1):
        out[at[real[t], t]] = _unit((alpha[t] * back)[real[t]])
        if t:
            step = (x[t] * back) @ a.T
            back = np.where(real[t][:, None], _unit(step) if t % RESCALE == 0 else step, back)
    return out


def label_texts(field: Field | None, texts: pa.Array):
    """For each text: language, score, number of words with letters, and the runs of equal labels as (language, words) lists."""
    n = len(texts)
    if field is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
    codes, distinct, offsets = letter_words(texts)
    if not len(codes):
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
    e = emissions(field, distinct)
    p = marginals(field, e[codes], offsets)
    length = np.diff(offsets)
    full = np.flatnonzero(length)
    mean = np.add.reduceat(p.astype(np.float64), offsets[:-1][full], axis=0) / length[full, None]
    best = mean.argmax(axis=1)
    lang, score = [UNKNOWN] * n, np.zeros(n)
    for d, k in zip(full.tolist(), best.tolist(), strict=True):
        lang[d] = field.labels[k]
    score[full] = np.clip(mean[np.arange(len(full)), best], 0.0, 1.0)
    word_label = p.argmax(axis=1)
    new = np.r_[True, word_label[1:] != word_label[:-1]]
    new[offsets[:-1][full]] = True
    run_at = np.flatnonzero(new)
    run_len = np.diff(np.r_[run_at, len(word_label)])
    owner = np.searchsorted(offsets, run_at, side="right") - 1
    runs: list[list] = [[] for _ in range(n)]
    for d, k, size in zip(owner.tolist(), word_label[run_at].tolist(), run_len.tolist(), strict=True):
        runs[d].append({"lang": field.labels[k], "words": size})
    return lang, score, length, runs


LABELLED = "doc_id long, lang_pred string, score double, n_words long, runs array<struct<lang:string,words:int>>"


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """Language, score, word count and runs of word labels for every row of docs (doc_id, text)."""
    runs_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for piece in slices(batches, "text", 4 << 20):
            lang, score, length, runs = label_texts(shared.value, piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(length.astype(np.int64)), pa.array(runs, runs_type)],
                                             ["doc_id", "lang_pred", "score", "n_words", "runs"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LABELLED)


def keep_known(docs: DataFrame, field: Field | None, min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has one language with a score of at least `min_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for piece in slices(batches, "text", 4 << 20):
            lang, score, _, _ = label_texts(shared.value, piece.column("text"))
            yield piece.filter(pa.array([name != UNKNOWN and s >= min_score for name, s in zip(lang, score, strict=True)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, usable, **sample) -> Field | None:
    """A field learned from the rows with a text and a language for which `usable` holds."""
    return train(sample_windows(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & usable).select("doc_id", "text", "lang"), **sample))

"""Line dedup by pairwise alignment: shared rare lines find overlapping documents, patience diff aligns them, and common blocks go from the later one.

A line is what stands between line feeds; its hash is of the text without white space (space, 0x09 to 0x0D) at its ends, and blank lines have none; its words are runs of other characters. Documents are ordered by doc_id (nulls
last, then by text hash). A line in 2 to RARE documents pairs each holder with every earlier one, at most RARE * (RARE - 1) / 2 pairs. A more
frequent line pairs each holder with the first one only, so that pairs stay in proportion to the lines. As that one may hold the line alone, each document is also paired with
the first holder of each of its runs: adjacent lines, from each line forward and from each backward, just enough for MIN_WORDS words. Every line of a block that an earlier
document has too is in such a run inside the block, so it meets an earlier holder of that run. Exact copies meet the first copy just as well.

A pair is aligned on arrays of line hashes: lines that occur once in both anchor the alignment by the longest increasing subsequence (patience), the stretches between anchors are
aligned in turn, and runs of equal lines around anchors extend them; a stretch without such a line is aligned by an exact longest common subsequence. A common block is a run of aligned lines
without a gap in either document. Blocks of at least MIN_WORDS words are deleted from the later document. Deletions of all its pairs add up.

Rows: null and empty texts have no line and stay as they are; rows equal in doc_id and text are one document and share its fate. An empty table gives no rows; texts are taken whole. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import checkpoint

RARE = 8
MIN_WORDS = 8
BLANKS = " \t\x0b\x0c\r"      # with the line feed, all that separates words


def with_lines(docs: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, text): key, doc_id, hashes of its lines (0: blank) and words in each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashes = F.transform(lines, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")))
    return rows.select("doc_id", "text_hash", hashes.alias("lines"), words.cast("array<int>").alias("words"))


def pairs(documents: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b), a before b, for documents with key and lines; with their words also the pairs of runs."""
    held = documents.select("key", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    facts = held.groupBy("line").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1")
    # Frequent and rare lines are joined apart: the first join has no grouping behind it, so a very frequent line's rows can be split.
    often = held.join(facts.where(F.col("n") > rare), "line").where(F.col("key") > F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))
    few = held.join(facts.where(F.col("n") <= rare), "line", "left_semi").groupBy("line").agg(F.sort_array(F.collect_list("key")).alias("keys"))     # at most `rare` keys
    each = few.select(F.posexplode("keys").alias("at", "b"), "keys").select(F.explode(F.slice("keys", 1, F.col("at"))).alias("a"), "b")
    found = each.unionByName(often)
    return (found.unionByName(run_pairs(documents, min_words)) if "words" in documents.columns else found).distinct()


def line_runs(lines: np.ndarray, words: np.ndarray, min_words: int) -> set[int]:
    """Hashes of the runs of two or more lines that reach `min_words` first, forward and backward from each line that is not blank."""
    total, out = np.r_[0, np.cumsum(words)], set()
    at = np.flatnonzero(words)
    ends, starts = np.searchsorted(total, total[at] + min_words), np.searchsorted(total, total[at + 1] - min_words, side="right") - 1
    for first, last in {*zip(at.tolist(), ends.tolist(), strict=True), *zip(starts.tolist(), (at + 1).tolist(), strict=True)}:
        if 0 <= first and last < len(total) and last - first > 1:
            out.add(xxhash.xxh64_intdigest(lines[first:last].tobytes(), 42))
    return out


def run_pairs(documents: DataFrame, min_words: int) -> DataFrame:
    """(a, b): each document b with the first holder a of each of its runs; a single line of enough words is paired as a line."""
    kind = dict(documents.dtypes)["key"]

    def run(batches):
        for batch in batches:
            which, runs = [], []
            for n, (lines, words) in enumerate(zip(batch.column("lines"), batch.column("words"), strict=True)):
                got = sorted(line_runs(lines.values.to_numpy(), words.values.to_numpy().astype(np.int64), min_words))
                which += [n] * len(got)
                runs += got
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(which, pa.int64())), pa.array(np.array(runs, np.uint64).view(np.int64))], ["key", "run"])
    held = documents.select("key", "lines", "words").mapInArrow(run, f"key {kind}, run long")
    first = held.groupBy("run").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1")
    return held.join(first, "run").where(F.col("key") > F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))


# ---- alignment -------------------------------------------------------------

def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines in both, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = _anchors(a, a0, a1, b, b0, b1)
        for (x, y), (u, v) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((x + 1, u, y + 1, v))
        out += anchors or longest(a, a0, a1, b, b0, b1)
    return sorted(out)


TABLE_BITS = 1 << 28        # rows of bits that an exact alignment holds at once; a larger stretch is halved


def longest(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a[a0:a1] and b[b0:b1]; of equally long ones, that which takes the last equal lines."""
    both = set(a[a0:a1]) & set(b[b0:b1])
    out, todo = [], [([i for i in range(a0, a1) if a[i] in both], [j for j in range(b0, b1) if b[j] in both])]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) * len(y) > TABLE_BITS and len(x) > 1:     # split b where the halves of a have the most in common with its two parts
            half = len(x) // 2
            head = _lengths([a[i] for i in x[:half]], [b[j] for j in y])
            tail = _lengths([a[i] for i in x[half:][::-1]], [b[j] for j in y[::-1]])[::-1]
            cut = int(np.argmax(head + tail))
            todo += [(x[:half], y[:cut]), (x[half:], y[cut:])]
            continue
        rows = _bit_rows([a[i] for i in x], [b[j] for j in y])
        i, j = len(x), len(y)
        while i and j:
            if a[x[i - 1]] == b[y[j - 1]]:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
            elif rows[i] >> (j - 1) & 1:        # no longer with b's line than without
                j -= 1
            else:
                i -= 1
    return out


def _bit_rows(a: list[int], b: list[int], last: bool = False) -> list[int]:
    """Row i has a zero bit j where line j of b makes the longest common subsequence with a[:i] longer; only the last row if asked."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if last:
            rows[0] = v
        else:
            rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each head of b, the empty one first."""
    v = _bit_rows(a, b, last=True)[-1]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[:len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _anchors(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    where, twice = {}, set()
    for i in range(a0, a1):
        twice.add(a[i]) if a[i] in where else where.setdefault(a[i], i)
    other, again = {}, set()
    for j in range(b0, b1):
        again.add(b[j]) if b[j] in other else other.setdefault(b[j], j)
    once = [(where[x], j) for x, j in other.items() if x in where and x not in twice and x not in again]
    once.sort(key=lambda p: p[1])
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(once)
    for n, (i, _) in enumerate(once):
        k = bisect_left(tops, i)
        back[n] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(i), at.append(n)
        else:
            tops[k], at[k] = i, n
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(once[n])
        n = back[n]
    return chain[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first, last) line of b in each aligned block of at least `min_words` words; blank lines take part but weigh nothing."""
    out, run = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            first, last = run[0][1], run[-1][1]
            if sum(words[first:last + 1]) >= min_words:
                out.append((first, last))
            run = []
        run.append((i, j))
    return out


def deletions(documents: DataFrame, found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, gone): sorted line numbers to delete from a document, over all its pairs."""
    earlier = documents.select(F.col("key").alias("a"), F.col("lines").alias("a_lines"))
    later = documents.select(F.col("key").alias("b"), F.col("lines").alias("b_lines"), F.col("words").alias("b_words"))
    both = found.join(earlier, "a").join(later, "b").select("b", "a_lines", "b_lines", "b_words")

    def run(batches):
        for batch in batches:
            keys, gone = [], []
            for key, a, b, words in zip(batch.column("b"), batch.column("a_lines"), batch.column("b_lines"), batch.column("b_words"), strict=True):
                blocks = common_blocks(a.values.to_pylist(), b.values.to_pylist(), words.values.to_pylist(), min_words)
                if blocks:
                    keys.append(key.as_py())
                    gone.append(np.concatenate([np.arange(x, y + 1, dtype=np.int32) for x, y in blocks]))
            ends = pa.array(np.cumsum([0, *map(len, gone)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("b").type), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(gone) if gone else np.empty(0, np.int32)))],
                                             ["key", "gone"])
    kind = dict(documents.dtypes)["key"]
    return both.mapInArrow(run, f"key {kind}, gone array<int>").select("key", F.explode("gone").alias("line")).groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the deleted lines, n_lines, n_deleted, for every row of docs (doc_id, text)."""
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    documents = with_lines(docs).withColumn("key", key).dropDuplicates(["key"])
    documents = checkpoint(documents.where(F.exists("lines", lambda x: x != 0)).select("key", "lines", "words"))
    gone = deletions(documents, pairs(documents, rare, min_words), min_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("key", key)
    joined = rows.join(gone, "key", "left")
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda n: F.get(lines, n))
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                         F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"))

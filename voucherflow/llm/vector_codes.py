"""Product codes of vectors by Lloyd rounds with adaptive bounds after Drake and Hamerly, in exact integer arithmetic.

A vector's components become integers floor(scale * x); the vector is cut into `parts` equal consecutive parts, and each part position has a
codebook of `entries` entries that starts as that part of the first kept rows by id. A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and then replaces each entry by the floored mean of its parts; an unused entry stays.

Bounds. With every part a row carries its entry, an upper bound on the distance to it, its b next closest entries with a lower bound each, in rising
order, and one outer bound below the distance to all others. After a round the bounds give way by how far the entries moved. A part whose
upper bound is strictly below all lower bounds keeps its entry without a distance being computed. Otherwise its own distance is computed;
if that does not settle it, those to the b listed entries; and if the best of these is not strictly below the outer bound, all. Distances decide as
integers, so ties and rounding cannot change a code; the stored bounds are rounded outwards. b starts at half of the entries and falls, to an eighth at
least, to the smallest that was enough for all but 1 % of the parts in the round before; a list cut short gives its lost bounds to the outer bound.

Spark. A row's integers and bounds are one row of a table in the shared run folder; each round is one pass over the last table that writes the
next and then removes the last. Every task adds one row with its sums and counts (parts x entries x width) to the table that it writes, so the
sums are exact under repeated tasks, and only they, never vectors, reach the driver: one row of fixed size for each task, summed in Spark first.
The codebooks and the first `entries` rows are all that the driver holds.

Rows whose vector is null or holds a null or non-finite component are dropped. Null ids come last in the order of ids; among equal ids the smaller vector comes first.
Vectors shorter than the longest count as filled up with zeros, to a multiple of `parts`; an empty vector is all zeros. With fewer rows than entries the
codebooks are shorter. Repeated rows count as often as they occur. Distances must fit 64 bits, or an error is raised before the first round. An empty table gives no rows
and empty codebooks. Only the id, vector and label columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import remove_folder, run_folder

ROWS = 4_096            # rows whose distances a task holds at once
SPILL = 0.01            # share of parts for which the next list may be too short


@dataclass
class Codes:
    rows: DataFrame             # vec_id, label, code (binary, one byte for each part), error
    codebooks: np.ndarray       # part, entry, component
    computed: list[int]         # distances computed in each pass; without bounds each would be rows * parts * entries
    lists: list[int]            # b of each pass

    def sha256(self) -> str:
        """Of all components in order, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, column: str, scale: int, label: str | None) -> DataFrame:
    """vec_id, label and v (array of long) of the rows whose vector is whole and finite."""
    x = F.col(column)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    kept = vectors.where(x.isNotNull() & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
                       F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


# ---- bounds ----------------------------------------------------------------

def state_type(parts: int, b: int) -> np.dtype:
    """What a row carries between rounds."""
    return np.dtype([("entry", "u1", (parts,)), ("upper", "f4", (parts,)), ("outer", "f4", (parts,)), ("next", "u1", (parts, b)), ("low", "f4", (parts, b))])


def _up(x):
    return np.nextafter(np.asarray(x, np.float32), np.float32(np.inf))


def _down(x):
    return np.nextafter(np.asarray(x, np.float32), np.float32(-np.inf))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of each row to each entry; through floats only where those are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 8 * x.shape[1] * most * most < 1 << 52:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a ** 2).sum(1)[:, None] - 2 * a @ c.T + (c ** 2).sum(1)).astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(-1)


def _own(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(-1)


def moves(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry moved at most."""
    return _up(np.sqrt(_own(before, after).astype(np.float64)))


def _sort_list(low, nxt):
    order = np.argsort(low, axis=1, kind="stable")
    return np.take_along_axis(low, order, 1), np.take_along_axis(nxt, order, 1)


def assign_all(x: np.ndarray, entries: np.ndarray, b: int):
    """entry, upper, outer, next and low of each row, from all distances."""
    d = _squared(x, entries)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    low, nxt = np.full((len(x), b), np.inf, np.float32), np.zeros((len(x), b), np.uint8)
    m = min(b, len(entries) - 1)
    low[:, :m], nxt[:, :m] = _down(far[:, 1:m + 1]), order[:, 1:m + 1]
    outer = _down(far[:, m + 1]) if len(entries) > m + 1 else np.full(len(x), np.inf, np.float32)
    return order[:, 0].astype(np.uint8), _up(far[:, 0]), outer, nxt, low


def assign_bounded(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, entry, upper, outer, nxt, low):
    """The state of each row after entries moved, how many distances that took, and how many rows needed 0, 1, ... b listed entries or all (b + 1)."""
    b = low.shape[1]
    upper, outer = _up(upper + moved[entry]), _down(outer - moved.max())
    low = np.where(np.isinf(low), low, _down(low - moved[nxt]))
    low, nxt = _sort_list(low, nxt)
    entry, nxt, low = entry.copy(), nxt.copy(), low.copy()
    floor = np.minimum(outer, low[:, 0]) if b else outer
    todo = np.flatnonzero(upper >= floor)
    needed = np.zeros(b + 2, np.int64)
    needed[0] = len(x) - len(todo)
    if not len(todo):
        return entry, upper, outer, nxt, low, 0, needed
    own = _own(x[todo], entries[entry[todo]])
    computed = len(todo)
    upper[todo] = _up(np.sqrt(own.astype(np.float64)))
    settled = upper[todo] < floor[todo]
    needed[0] += settled.sum()
    todo, own = todo[~settled], own[~settled]
    if not len(todo):
        return entry, upper, outer, nxt, low, computed, needed
    # Exact distances to the listed entries; unused places of a list never win.
    some = np.where(np.isinf(low[todo]), np.iinfo(np.int64).max, ((x[todo][:, None, :] - entries[nxt[todo]]) ** 2).sum(-1))
    computed += int((~np.isinf(low[todo])).sum())
    who = np.concatenate([entry[todo][:, None], nxt[todo]], axis=1)
    d = np.concatenate([own[:, None], some], axis=1)
    order = np.lexsort((who, d), axis=1)
    who, d = np.take_along_axis(who, order, 1), np.take_along_axis(d, order, 1)
    far = np.sqrt(d.astype(np.float64))
    near = _up(far[:, 0])
    known = near < outer[todo]
    reach = (low[todo] <= upper[todo][:, None]).sum(1)
    needed += np.bincount(np.where(known, reach, b + 1), minlength=b + 2)
    at = todo[known]
    entry[at], upper[at], nxt[at] = who[known, 0], near[known], who[known, 1:]
    low[at] = np.where(d[known, 1:] == np.iinfo(np.int64).max, np.inf, _down(far[known, 1:]))
    rest = todo[~known]
    if len(rest):
        entry[rest], upper[rest], outer[rest], nxt[rest], low[rest] = assign_all(x[rest], entries, b)
        computed += len(rest) * len(entries)
    return entry, upper, outer, nxt, low, computed, needed


def shorter(state: np.ndarray, b: int) -> np.ndarray:
    """The state with lists of b entries; the bounds that go join the outer bound."""
    parts, old = state["low"].shape[1:]
    out = np.zeros(len(state), state_type(parts, b))
    for name in ("entry", "upper"):
        out[name] = state[name]
    out["next"], out["low"] = state["next"][:, :, :b], state["low"][:, :, :b]
    out["outer"] = np.minimum(state["outer"], state["low"][:, :, b:].min(axis=2)) if old > b else state["outer"]
    return out


def next_length(needed: np.ndarray, entries: int) -> int:
    """The smallest list that was enough for all but SPILL of the parts; an eighth of the entries at least, and never longer than before."""
    b = len(needed) - 2
    enough = np.cumsum(needed[:b + 1]) >= (1 - SPILL) * needed.sum()
    return max(min(b, max(1, entries // 8)), int(np.argmax(enough)) if enough.any() else b)


# ---- rounds ----------------------------------------------------------------

def _fixed(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column as an array of one dtype."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype, (int(at[-1]) - int(at[0])) // np.dtype(dtype).itemsize, int(at[0]))


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    at = np.arange(len(rows) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def _label_type(frame: DataFrame) -> str:
    return frame.schema["label"].dataType.simpleString()


def compress(vectors: DataFrame, column: str, label: str | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of every whole vector after `rounds` rounds and the final codebooks. `parts` * components must fit the driver; entries are 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number takes one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    ints = integers(vectors, column, scale, label)
    kind = _label_type(ints)
    facts = ints.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most"), F.count("*").alias("n")).first()
    width = parts * max(1, math.ceil((facts["width"] or 0) / parts))
    each, most = width // parts, int(facts["most"] or 0)
    if 4 * width * (most + 1) ** 2 >= 1 << 63 or most * max(1, facts["n"]) >= 1 << 63:
        raise ValueError("components are too large for exact distances in 64 bits")
    store = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), width), np.int64)
    for n, r in enumerate(first):
        books[n, :len(r["v"])] = r["v"]
    books = np.ascontiguousarray(books.reshape(len(first), parts, each).swapaxes(0, 1))
    if not len(first):
        empty = spark.createDataFrame([], f"vec_id long, label {kind}, code binary, error long")
        return Codes(empty, books, [], [])
    count, b = len(first), max(1, len(first) // 2)
    folder, names = run_folder(spark, "vector-codes"), ["vec_id", "label", "x", "state", "code", "error", "sums", "needed", "computed"]
    schema = f"vec_id long, label {kind}, x binary, state binary, code binary, error long, sums array<long>, needed array<long>, computed long"

    def packed(batches):
        for batch in batches:
            lists = batch.column("v")
            x = np.zeros((len(lists), width), store)
            at = lists.offsets.to_numpy()
            size = np.diff(at)
            flat = lists.values.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), size)
            x[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0]:at[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(x)], ["vec_id", "label", "x"])

    def pass_over(books, moved, b_old, b_new, last):
        """Assign every row; at the end one row with the task's sums."""
        def run(batches):
            sums, needed, computed = np.zeros((parts, count, each + 1), np.int64), np.zeros((b_old or b_new) + 2, np.int64), 0
            kind_ = None
            for whole in batches:
                kind_ = whole.schema.field("label").type
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    x = _fixed(batch.column("x"), store).reshape(len(batch), parts, each).astype(np.int64)
                    old = _fixed(batch.column("state"), state_type(parts, b_old)) if moved is not None else None
                    new = np.zeros(len(batch), state_type(parts, b_old or b_new))
                    error = np.zeros(len(batch), np.int64)
                    for p in range(parts):
                        if old is None:
                            got = assign_all(x[:, p], books[p], b_new)
                            computed += len(x) * count
                        else:
                            *got, used, depth = assign_bounded(x[:, p], books[p], moved[p], *(old[f][:, p] for f in ("entry", "upper", "outer", "next", "low")))
                            computed += used
                            needed += depth
                        for f, values in zip(("entry", "upper", "outer", "next", "low"), got, strict=True):
                            new[f][:, p] = values
                        near = got[0]
                        if last:
                            error += _own(x[:, p], books[p][near])
                        else:
                            np.add.at(sums[p, :, :each], near, x[:, p])
                            sums[p, :, each] += np.bincount(near, minlength=count)
                    state = None if last else _binary(shorter(new, b_new).view(np.uint8).reshape(len(new), -1))
                    none = pa.nulls(len(batch), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), batch.column("label"), pa.nulls(len(batch), pa.binary()) if last else batch.column("x"), pa.nulls(len(batch), pa.binary()) if last else state,
                         _binary(new["entry"]), pa.array(error), none, none, pa.nulls(len(batch), pa.int64())], names)
            if kind_ is not None:
                one = [pa.nulls(1, t) for t in (pa.int64(), kind_, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*one, pa.array([sums.ravel()], pa.list_(pa.int64())), pa.array([needed], pa.list_(pa.int64())), pa.array([computed])], names)
        return run

    source, moved, b_old = ints.mapInArrow(packed, f"vec_id long, label {kind}, x binary"), None, 0
    computed, lists, last_path, b_new = [], [], None, b
    for n in range(rounds + 1):
        path = f"{folder}/{n}"
        source.mapInArrow(pass_over(books, moved, b_old, b_new, n == rounds), schema).write.parquet(path)
        if last_path:
            remove_folder(spark, last_path)
        written, last_path = spark.read.schema(schema).parquet(path), path
        rows, tasks = written.where("sums IS NULL"), written.where("sums IS NOT NULL")
        lists.append(b_new)
        if n == rounds:
            computed.append(tasks.agg(F.sum("computed").alias("c")).first()["c"])
            return Codes(rows.select("vec_id", "label", "code", "error"), books, computed, lists)
        total = _added(tasks, "sums", parts * count * (each + 1)).reshape(parts, count, each + 1)
        needed = _added(tasks, "needed", (b_old or b_new) + 2)
        computed.append(tasks.agg(F.sum("computed").alias("c")).first()["c"])
        used = total[:, :, each:]
        after = np.where(used > 0, total[:, :, :each] // np.maximum(used, 1), books)
        moved = np.stack([moves(books[p], after[p]) for p in range(parts)])
        books, b_old = after, b_new
        b_new = min(b_new, next_length(needed, count)) if needed.sum() else b_new
        source = rows.select("vec_id", "label", "x", "state")
    raise AssertionError("unreachable")


def _added(tasks: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the tasks' arrays, place by place; as many rows as places reach the driver."""
    rows = tasks.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes and label_error: the error summed over the rows of equal label, nulls together."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")

"""SimHash fingerprints and exact radius search among them with vantage-point trees.

A fingerprint has 64 bits; bit i is set if it is set in over half of the shingle hashes (XXH64, seed 42, of the UTF-8 bytes).
Pairs at `radius` or fewer differing bits are linked, and links are closed to components.

Search. Hamming distance over a block of the bits is a metric too, and never larger than the distance over all bits. When the 64 bits
are dealt into m blocks, two fingerprints within `radius` differ in at most radius // m bits of some block. So m forests of
vantage-point trees are built, one for each block, each searched with that smaller radius. A node holds a vantage point and the median
distance to it; a fingerprint lives in one leaf (its home shard) and also visits each leaf that the triangle bound does not exclude,
that is where |distance - median| leaves the boundary within reach. Trees are grown on the driver from at most `sample`
fingerprints taken by hash; every fingerprint is then routed and compared. Shards with many members are cut into tiles, all pairs of
which are compared in tasks of their own, so no shard has to fit one task. Within a tile only a spanning forest of its links leaves the
task: components need no more, and no pair list of a group is ever made.

Equal fingerprints are one node. Rows: a null or empty text, or one without words, has fingerprint zero and is linked like any other;
null doc_ids are ignored when the smallest is sought, and a component of such rows only has a null id; repeated rows stay; an
empty table gives no rows; texts are taken whole. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm import graph
from voucherflow.llm.common import checkpoint, dealt, mapped, pack, pieces, remove_folder, run_folder, slices, store_keys, unpack, write_array, written

SAMPLE = 1 << 16        # fingerprints that shape the trees
LEAF = 2_000            # members a shard should have
TILE = 16_384           # members of a shard compared in one task
CHUNK = 1 << 16         # shingle hashes counted at once
PAIRS = 1 << 19


# ---- fingerprints ----------------------------------------------------------

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned hashes of all runs of `words` words, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else (w,)
    return np.array(array("Q", [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, runs)]), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes that are independent of `h` for each k > 0."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash and fp, a long with the fingerprint's bits."""
    def run(batches):
        for piece in slices(batches, "text"):
            got = np.array([fingerprint(shingle_hashes(text, words)) for text in piece.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), pa.array(got.view(np.int64))], ["doc_id", "text_hash", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


# ---- trees -----------------------------------------------------------------

@dataclass
class Tree:
    word: int                 # which fingerprint it looks at
    mask: int                 # bits that this tree's metric looks at
    reach: int                # radius in that metric
    vantage: np.ndarray       # uint64 for each node
    median: np.ndarray        # inside: distance <= median; -1 marks a leaf
    left: np.ndarray          # child inside, or the leaf's number
    right: np.ndarray         # child outside
    leaves: int
    home_tiles: np.ndarray    # tiles of a leaf's own members
    visit_tiles: np.ndarray   # tiles of all that visit it

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of fingerprint, leaf and whether it is at home there, for each visit."""
        who, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        done = []
        while len(who):
            end = self.median[node] < 0
            done.append((who[end], self.left[node[end]], home[end]))
            who, node, home = who[~end], node[~end], home[~end]
            d = np.bitwise_count((fps[who] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int64)
            m = self.median[node]
            inside, outside = d - self.reach <= m, d + self.reach > m
            who, home, node = (np.r_[who[inside], who[outside]], np.r_[home[inside] & (d <= m)[inside], home[outside] & (d > m)[outside]],
                               np.r_[self.left[node[inside]], self.right[node[outside]]])
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (who, node, home)


def grow(sample: np.ndarray, word: int, mask: int, reach: int, leaf: float, scale: float, tile: int) -> Tree:
    """A tree over the sample whose leaves hold about `leaf` sample members; `scale` is the number of fingerprints a member stands for."""
    rng = np.random.default_rng(mask % (1 << 32))
    vantage, median, left, right, leaves = [], [], [], [], 0
    todo = [(sample, -1, 0)]
    while todo:
        part, parent, side = todo.pop()
        here = len(median)
        if parent >= 0:
            (left, right)[side][parent] = here
        best = None
        if len(part) > leaf:
            for v in rng.choice(part, min(8, len(part)), replace=False):     # of some vantage points, the one whose boundary few straddle
                d = np.bitwise_count((part ^ v) & np.uint64(mask)).astype(np.int64)
                for m in np.unique(np.quantile(d, [0.4, 0.5, 0.6]).astype(np.int64)):
                    near, share = float(np.mean((d - reach <= m) & (d + reach > m))), float(np.mean(d <= m))
                    if 0 < share < 1 and (best is None or near + abs(share - 0.5) < best[0]):
                        best = (near + abs(share - 0.5), v, int(m), d)
        if best is None:
            vantage.append(0), median.append(-1), left.append(leaves), right.append(-1)
            leaves += 1
            continue
        _, v, m, d = best
        vantage.append(int(v)), median.append(m), left.append(-1), right.append(-1)
        todo += [(part[d > m], here, 1), (part[d <= m], here, 0)]
    tree = Tree(word, mask, reach, np.array(vantage, np.uint64), np.array(median, np.int64), np.array(left, np.int64), np.array(right, np.int64), leaves,
                np.ones(leaves, np.int64), np.ones(leaves, np.int64))
    _, at, home = tree.route(sample)
    tree.home_tiles = np.maximum(1, np.ceil(np.bincount(at[home], minlength=leaves) * scale / tile)).astype(np.int64)
    tree.visit_tiles = np.maximum(1, np.ceil(np.bincount(at, minlength=leaves) * scale / tile)).astype(np.int64)
    return tree


def bit_blocks(blocks: int) -> list[int]:
    """Masks of `blocks` runs of the 64 bits, as equal as they can be."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


# ---- links -----------------------------------------------------------------

def spanning(home: np.ndarray, visit: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, smallest member), of the links between two sets.

    A member is a row (id, fingerprint, further fingerprints); a link needs at most `radius` differing bits over all of them."""
    every = np.unique(np.r_[home[:, 0], visit[:, 0]])
    label = np.arange(len(every))
    hi, vi = np.searchsorted(every, home[:, 0]), np.searchsorted(every, visit[:, 0])
    head = [np.ascontiguousarray(visit[:, k]) for k in range(1, min(3, visit.shape[1]))]
    rows = max(16, min(rows, PAIRS // max(1, len(visit))))      # pairs in reach that a task holds at once
    for at in range(0, len(home), rows):
        d = sum(np.bitwise_count(home[at:at + rows, k, None] ^ v[None, :]) for k, v in enumerate(head, 1))
        i, j = np.nonzero(d <= radius)      # two words tell chance pairs apart; the others only add to the distance
        apart = label[hi[at + i]] != label[vi[j]]       # a group that is connected already takes no more work
        i, j = i[apart], j[apart]
        if home.shape[1] > 3:
            near = np.bitwise_count(home[at + i, 1:] ^ visit[j, 1:]).sum(axis=1, dtype=np.int64) <= radius
            i, j = i[near], j[near]
        _hook(label, hi[at + i], vi[j])
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of linked members in place; each label ends at its set's smallest member."""
    while True:
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return
        a, b = a[far], b[far]
        top, low = np.maximum(x[far], y[far]), np.minimum(x[far], y[far])
        np.minimum.at(label, top, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links(nodes: DataFrame, total: int, radius: int, blocks: int, reach: int, sample: int = SAMPLE, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between ids that connect linked `nodes` (id, fp and perhaps w1, w2, ...), as spanning forests of tiles.

    There is a tree for each of `blocks` blocks of bits of each fingerprint; pairs that agree to `reach` bits in one block at least meet."""
    columns = ["id", "fp", *sorted(c for c in nodes.columns if c[0] == "w")]
    share = min(1.0, sample / max(1, total))
    # A hash chooses the sample, the same on every run: about `sample` values, never over twice as many.
    chosen = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select(columns[1:]).limit(2 * sample)
    seed = np.array([tuple(r) for r in chosen.collect()], np.int64).reshape(-1, len(columns) - 1).view(np.uint64)
    seed = seed[np.lexsort(seed.T[::-1])] if len(seed) else seed
    scale = max(1.0, total / max(1, len(seed)))
    trees = [grow(np.ascontiguousarray(seed[:, k]), k + 1, mask, reach, max(1.0, leaf / scale), scale, tile) for k in range(len(columns) - 1) for mask in bit_blocks(blocks)]
    first = np.cumsum([0, *(int((t.home_tiles * t.visit_tiles).sum()) for t in trees)])

    def route(batches):
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)) for c in columns], axis=1).view(np.uint64)
            rows = rows[np.argsort(rows[:, 0])]
            for tree, base in zip(trees, first, strict=False):
                tiles = tree.home_tiles * tree.visit_tiles
                start = base + np.cumsum(tiles) - tiles
                who, leaf_, home = tree.route(np.ascontiguousarray(rows[:, tree.word]))
                order = np.lexsort((who, leaf_))
                who, leaf_, home = who[order], leaf_[order], home[order]
                cut = np.flatnonzero(np.r_[True, leaf_[1:] != leaf_[:-1]]) if len(leaf_) else np.empty(0, np.int64)
                shard, mine, seen = [], [], []
                for a, b in zip(cut, np.r_[cut[1:], len(leaf_)], strict=True):
                    k = int(leaf_[a])
                    nh, nv = int(tree.home_tiles[k]), int(tree.visit_tiles[k])
                    own, all_ = _spread(rows[who[a:b][home[a:b]]], nh), _spread(rows[who[a:b]], nv)
                    alike = reach == 0 and nh == nv == 1        # all visitors are at home
                    for r in range(nh):
                        for c in range(nv):
                            shard.append(int(start[k]) + r * nv + c), mine.append(_packed(own[r])), seen.append(None if alike else _packed(all_[c]))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(mine, pa.binary()), pa.array(seen, pa.binary())],
                                                 ["shard", "home", "visit"])

    def join(group):
        home, visit = ([_unpacked(x, len(columns)) for x in group.column(c).to_pylist() if x is not None] for c in ("home", "visit"))
        home = np.concatenate(home)
        a, b = spanning(home, np.concatenate(visit) if visit else home, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    packed = nodes.select(columns).mapInArrow(route, "shard long, home binary, visit binary")
    return packed.groupBy("shard").applyInArrow(join, "a long, b long")


def _packed(rows: np.ndarray) -> bytes:
    """Rows sorted by id; the id is left out where it is the fingerprint itself."""
    same = rows.shape[1] == 2
    return pack(rows[:, 0]) if same else b"".join([len(ids := pack(rows[:, 0])).to_bytes(4, "little"), ids, rows[:, 1:].tobytes()])


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    if width == 2:
        return np.repeat(unpack(blob, np.uint64)[:, None], 2, axis=1)
    size = int.from_bytes(blob[:4], "little")
    ids = unpack(blob[4:4 + size], np.uint64)
    return np.concatenate([ids[:, None], np.frombuffer(blob[4 + size:], np.uint64).reshape(len(ids), width - 1)], axis=1)


def _spread(rows: np.ndarray, tiles: int) -> list[np.ndarray]:
    if tiles == 1:
        return [rows]
    at = ((rows[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(tiles)
    return [rows[at == k] for k in range(tiles)]


def _first():
    """What orders the rows of a component: doc_id, nulls last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")


def components(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_hash, fp (long), component_id: the smallest doc_id reachable through linked fingerprints, is_first: whether the row has the
    smallest doc_id (then text hash) of its component. With a reach of radius // blocks in some block every link is found."""
    prints = checkpoint(fingerprints(docs, words).withColumn("id", F.col("fp")))
    nodes = checkpoint(prints.groupBy("id").agg(F.min(_first()).alias("first"))).withColumn("fp", F.col("id"))
    roots = graph.components(links(nodes.select("id", "fp"), nodes.count(), radius, blocks, radius // blocks, sample))
    placed = nodes.select("id", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = checkpoint(placed.groupBy("root").agg(F.min("first").alias("least")))     # apart, so that a large component's rows can be split
    by_node = placed.join(least, "root").select("id", "least")
    return prints.join(by_node, "id").select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), (_first() == F.col("least")).alias("is_first"))


# ---- near copies -----------------------------------------------------------

# Two sets of shingles with i members in common are near copies if i / (a + b - i) >= 0.8, that is 9 i >= 4 (a + b).
NEAR_RADIUS = 72        # of 256 bits; pairs of similarity 0.8 differ in 31 to 48 at the mean, with a deviation of 6
GROUP_TILE = 4_096      # sets of a group compared with as many others in one task
FEW = 16                # a shingle that so many sets of a tile hold is counted by pairs, a more frequent one by a product
NEAR_MISS = 0.02        # share of pairs of similarity 0.8 that may agree in no block at all
NEAR_DIFFER = 0.15      # share of bits in which such pairs differ
SET_BYTES = 64 << 20    # of one file of shingle sets


def near_plan(total: int, leaf: int = LEAF) -> tuple[int, int]:
    """Fingerprints and blocks of each for `total` sets: blocks long enough that about `leaf` sets agree in one by chance, and so many of them that
    pairs of similarity 0.8 agree in one or more but for NEAR_MISS of them."""
    bits = max(10, math.ceil(math.log2(max(1.0, total / leaf))))
    blocks = max(1, round(64 / bits))
    agree = (1 - NEAR_DIFFER) ** (64 / blocks)
    return math.ceil(math.log(NEAR_MISS) / math.log1p(-agree) / blocks), blocks


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty for a text without words."""
    return np.unique(shingle_hashes(text, words))


def row_key():
    """What stands for a document: its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))


def set_prints(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """doc_id, text_hash, key, node (hash of the shingle set) and the set's fingerprints fp, w1, w2, ..."""
    names = ["fp", *(f"w{k}" for k in range(1, prints))]

    def run(batches):
        for piece in slices(batches, "text"):
            node, got = np.zeros(piece.num_rows, np.uint64), np.zeros((prints, piece.num_rows), np.uint64)
            for row, text in enumerate(piece.column("text").to_pylist()):
                h = shingle_set(text, words)
                node[row] = xxhash.xxh64_intdigest(h.tobytes(), 42)
                got[:, row] = [fingerprint(_remix(h, k)) for k in range(prints)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "text_hash", "key")), *(pa.array(x.view(np.int64)) for x in (node, *got))],
                                             ["doc_id", "text_hash", "key", "node", *names])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, key long, node long, " + ", ".join(f"{n} long" for n in names))


class SetStore:
    """Shingle sets in files by hash range of their node, mapped by the tasks that compare them."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets

    def __getitem__(self, node: int) -> np.ndarray:
        bucket = int(dealt(np.array([node], np.uint64), self.buckets)[0])
        nodes, ends, members = (mapped(f"{self.folder}/{bucket}.{c}") for c in ("node", "end", "member"))
        at = int(np.searchsorted(nodes, np.uint64(node)))
        return members[int(ends[at - 1]) if at else 0:int(ends[at])]


def shared_members(sets: list[np.ndarray], first: int) -> np.ndarray:
    """(first, rest): how many members each of the first sets shares with each of the others; all with all if `first` is their number."""
    n = len(sets)
    low = 0 if first == n else first
    out = np.zeros((first, n - low), np.float32)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(row) else np.empty(0, np.int64)
    count = np.bincount(code)
    often = count[code] > FEW
    order = np.argsort(code[~often], kind="stable")
    c, r = code[~often][order], row[~often][order]
    for lag in range(1, FEW):       # sets that hold the same rare shingle stand within so many places
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        a, b = r[:-lag][same], r[lag:][same]
        for x, y in ((a, b), (b, a)):
            on = (x < first) & (y >= low)
            np.add.at(out, (x[on], y[on] - low), 1)
    place = np.cumsum(count > FEW) - 1
    column, r = place[code[often]], row[often]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 2_048):
        on = (column >= at) & (column < at + 2_048)
        dense = np.zeros((n, 2_048), np.float32)
        dense[r[on], column[on] - at] = 1
        out += dense[:first] @ dense[low:].T
    return out


def near_forest(nodes: np.ndarray, sets: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links of the first nodes with the others, or of all."""
    size, label = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    low, shared = 0 if first == len(sets) else first, shared_members(sets, first)
    for at in range(0, first, 256):
        i, j = np.nonzero(9 * shared[at:at + 256] >= 4 * (size[at:min(first, at + 256), None] + size[None, low:]))
        _hook(label, i + at, j + low)
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return nodes[moved], nodes[label[moved]]


def store_sets(docs: DataFrame, keys: DataFrame, words: int, folder: str) -> SetStore:
    """The shingle sets of the documents whose `key` is in keys, made again from their texts, which do not move."""
    wanted = store_keys(keys, f"{folder}/wanted")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = pieces(2 * size, SET_BYTES)

    def make(batches):
        made: set[int] = set()      # rows equal in id and text are made once in a task
        for piece in slices(batches, "text"):
            key = np.asarray(piece.column("key")).view(np.uint64)
            rows = [n for n in np.flatnonzero(wanted.has(key)).tolist() if not (int(key[n]) in made or made.add(int(key[n])))]
            sets = [shingle_set(t, words) for t in piece.column("text").take(pa.array(rows, pa.int64())).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(dealt(node, buckets)), pa.array(node.view(np.int64)), pa.array([h.tobytes() for h in sets], pa.binary())], ["bucket", "node", "members"])

    def write(group):
        bucket = group.column("bucket")[0].as_py()
        node = np.asarray(group.column("node").combine_chunks()).view(np.uint64)
        node, first = np.unique(node, return_index=True)
        blobs = group.column("members").take(pa.array(first)).to_pylist()
        write_array(f"{folder}/{bucket}.node", node)
        write_array(f"{folder}/{bucket}.end", np.cumsum([len(x) // 8 for x in blobs]).astype(np.uint64))
        write_array(f"{folder}/{bucket}.member", np.frombuffer(b"".join(blobs), np.uint64))
        return pa.table({"bucket": pa.array([bucket], pa.int64())})
    docs.select(row_key().alias("key"), "text").mapInArrow(make, "bucket long, node long, members binary").groupBy("bucket").applyInArrow(write, "bucket long").collect()
    return SetStore(folder, buckets)


def near_edges(docs: DataFrame, nodes: DataFrame, total: int, words: int, blocks: int, folder: str, tile: int = GROUP_TILE) -> DataFrame:
    """Edges (a, b) of exact similarity 0.8 or more that connect the near copies among `nodes` (id, key, fp, w1, ...).

    The search of the trees joins the few nodes that have another in reach to groups. Within a group all pairs of sets are compared, in tiles of `tile` by `tile`
    sets, by the members that they share; small groups go together into one task."""
    prints = nodes.drop("key")
    maybe = written(links(prints, total, NEAR_RADIUS * (len(prints.columns) - 1) // 4, blocks, 0), f"{folder}/maybe")
    roots = graph.components(maybe)
    members = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), f"{folder}/groups")
    sets = store_sets(docs, nodes.join(members.select(F.col("node").alias("id")), "id", "left_semi").select("key"), words, f"{folder}/sets")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    few = pieces(members.count(), tile)
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    each = members.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    each = each.select("root", "node", "own", F.when(F.col("cuts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(few))).alias("task"),
                       (F.col("cuts") > 1).alias("large"), F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"))

    def compare(group):
        root, node, own = (np.asarray(group.column(x).combine_chunks()) for x in ("root", "node", "own"))
        r, out = group.column("r")[0].as_py(), []
        order = np.lexsort((node, own != r, root))
        root, node, own = root[order], node[order], own[order]
        cut = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(root)], strict=True):
            ids = node[a:b]
            found = [sets[int(x)] for x in ids.view(np.uint64)]
            out.append(near_forest(ids, found, int((own[a:b] == r).sum())))
        return pa.table({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})
    return each.groupBy("large", "task", "r", "c").applyInArrow(compare, "a long, b long")


def near_unique(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of docs, all columns as they are, for each group of near copies: the row with the smallest doc_id, nulls last.

    Near copies agree in 0.8 or more of their distinct shingles of five words (exact Jaccard, up to equal 64-bit hashes); groups are closed over links.
    Candidates come from vantage-point trees over blocks of the sets' fingerprints, as many as near_plan() gives for their number, and every link is checked
    on the whole sets, so no wrong link is made; about NEAR_MISS of the pairs at 0.8 itself can be missed, fewer above. Texts without words have the empty set
    and are one group. Rows equal in doc_id and text are one document, of which one row stays. Only 64-bit keys of rows are shuffled, never texts or
    further columns; those keep their values whatever their names."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "near-copies")
    prints, blocks = near_plan(docs.count())
    rows = written(set_prints(docs, words, prints), f"{folder}/prints")
    names = [c for c in rows.columns if c not in ("doc_id", "text_hash", "key", "node")]
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "key")
    nodes = written(rows.groupBy("node").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in names]), f"{folder}/nodes")
    edges = near_edges(docs, nodes.select(F.col("node").alias("id"), F.col("first.key").alias("key"), *names), nodes.count(), words, blocks, folder)
    roots = graph.components(edges)
    placed = written(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{folder}/placed")
    least = written(placed.groupBy("root").agg(F.min("first").alias("least")), f"{folder}/least")    # apart, so that a large component's rows can be split
    stays = placed.join(least, "root").select("node", F.col("least.key").alias("stays"))
    marks = written(rows.join(stays, "node").groupBy("key").agg(F.max(F.col("key") == F.col("stays")).alias("stays"), F.count("*").alias("n"))
                    .where("NOT stays OR n > 1"), f"{folder}/marks")
    marked = store_keys(marks.select("key"), f"{folder}/marked")
    several = store_keys(marks.where("stays").select("key"), f"{folder}/several")
    whole = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def chosen(keys, inside):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(keys.has(np.asarray(batch.column("key")).view(np.uint64)) == inside))
        return whole.mapInArrow(run, whole.schema)
    for name in ("prints", "nodes", "maybe", "groups", "sets", "placed", "least", "marks"):
        remove_folder(spark, f"{folder}/{name}")
    return chosen(marked, False).select("row.*").unionByName(chosen(several, True).dropDuplicates(["key"]).select("row.*"))


def hex_of(column: str):
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))

"""Operator 12, hard-negative mining, by bounds along spanning trees of anchors.

Every row is a vector with a label; some are anchors. A row's score is its integer inner product with the anchor. An
anchor's positives are its best other rows of the same label, and for each positive its negatives are the best rows of another
label whose score lies in the window [low %, high %] of the positive's. Higher scores come first, ties by smaller id.

1. Anchors are sorted by the signs of a few projections and cut into trees of at most `TREE`; each is a minimum spanning tree
   by distance, so that parents and children are near each other.
2. A pass holds the trees of at most `PASS_ANCHORS` anchors and `PASS_VALUES` components, broadcasts them and meets all rows
   in blocks of `BLOCK`. Down a tree, |<c, child> - <c, parent>| <= |child - parent| * |c|, so the parent's score, or the bounds
   that it has itself, plus and minus the edge times the candidate's norm bound the child's. Only candidates whose bounds reach
   the least score that can still count, or overlap a window, are scored again, exactly.
3. Each pass first meets one row in `SEED`, drawn by hash. The k-th best of these bounds the k-th best of all from below, so
   the tasks of the full scan pass on little more than what counts, whatever their number. Nothing depends on the draw.
4. What tasks pass on is ranked within each anchor and positive.

Scale: rows are never shuffled, whatever their labels or copies; only ranked candidates are, by anchor. The driver holds one
pass: its anchors, and the scores of at most n_positives * (n_negatives + 1) + 1 candidates for each. Anchors times rows is the
question itself: it is answered in blocks of anchors against all rows, one scan for positives and one for negatives a pass.

Nulls: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose squared norm
doesn't fit a long, since their scores wouldn't. A null id is no anchor of the query and loses ties; it can be a
positive or a negative, with a null id in the result. An empty vector scores 0. Of vectors of unlike lengths the shorter counts
as filled up with zeros. Repeated rows are rows of their own: each repeated anchor has its own results, which are equal; the row
itself is left out once. An anchor without positives, and a positive without negatives, gives no row. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rounds

TREE = 2048
PASS_ANCHORS = 8192
PASS_VALUES = 1 << 22
BLOCK = 1024
SEED = 32
SIGNS = 12
#: Squared norms beyond which a score may not fit a long.
MOST_NORM = float(1 << 62)
#: Products of squared norms below which every partial sum of a score is a whole number in doubles (by Cauchy and Schwarz).
EXACT = float(1 << 53) ** 2
LEAST, MOST = -(1 << 62), 1 << 62

TREE_SCHEMA = "tree long, ids array<long>, labels array<string>, parents array<int>, edges array<double>, width int, data binary"
FOUND_SCHEMA = "anchor int, slot int, anchor_id long, positive_id long, positive_score long, id long, score long"


# --- vectors ------------------------------------------------------------------------------------------------------


@dataclass
class Vectors:
    """Quantised vectors that take part, as a matrix filled up with zeros: `width` columns of those that they have."""

    ids: np.ndarray
    no_id: np.ndarray
    labels: list[str]
    lengths: np.ndarray
    norms2: np.ndarray
    flat: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def matrix(self, width: int, at: slice) -> np.ndarray:
        lengths, starts = self.lengths[at], self.starts[at]
        n = len(lengths)
        if n and (lengths == lengths[0]).all() and (np.diff(starts) == lengths[0]).all():
            has = self.flat[starts[0] : starts[0] + n * lengths[0]].reshape(n, lengths[0])[:, :width]
            return has if has.shape[1] == width else np.pad(has, ((0, 0), (0, width - has.shape[1])))
        out = np.zeros((n, width))
        for i, (start, length) in enumerate(zip(starts, np.minimum(lengths, width), strict=True)):
            out[i, :length] = self.flat[start : start + length]
        return out


def vectors_of(batch: pa.RecordBatch, scale: int) -> Vectors:
    """The rows (id, label, v) of `batch` that take part."""
    v = batch.column("v")
    lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(float(scale) * v.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
        norms2 = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=flat * flat, minlength=len(lengths))
    keep = np.flatnonzero(norms2 < MOST_NORM)  # false for what isn't finite
    ids, labels = batch.column("id"), batch.column("label").to_pylist()
    starts = np.cumsum(lengths) - lengths
    return Vectors(
        ids.fill_null(0).to_numpy(zero_copy_only=False)[keep], ids.is_null().to_numpy(zero_copy_only=False)[keep], [labels[i] for i in keep], lengths[keep], norms2[keep], flat, starts[keep]
    )


def scores(rows: np.ndarray, anchor: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as longs; `most`: the greatest product of squared norms."""
    if most < EXACT:
        return (rows @ anchor).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


# --- trees --------------------------------------------------------------------------------------------------------


def sign_codes(vectors: Vectors) -> np.ndarray:
    """Signs of `SIGNS` fixed random projections, as bits."""
    width = int(vectors.lengths.max(initial=0))
    planes = np.random.default_rng(12).standard_normal((width, SIGNS))
    return ((vectors.matrix(width, slice(None)) @ planes > 0) << np.arange(SIGNS)).sum(axis=1)


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edges) of a minimum spanning tree of the rows of `a`: parents stand before children and are given by
    their place in the order, the root's is -1."""
    n, squares = len(a), (a * a).sum(axis=1)
    near, above, place = np.full(n, np.inf), np.full(n, -1), np.empty(n, np.int64)
    order, open_ = [], np.ones(n, bool)
    for k in range(n):
        at = int(np.argmin(np.where(open_, near, np.inf))) if k else 0
        at = at if open_[at] else int(np.argmax(open_))  # distances that overflow
        open_[at], place[at] = False, k
        order.append(at)
        far = squares + squares[at] - 2 * (a @ a[at])
        closer = open_ & (far < near)
        near[closer], above[closer] = far[closer], at
    order = np.array(order, np.int64)
    up = above[order]
    up[1:][up[1:] < 0] = order[0]
    edges = np.sqrt(((a[order] - a[np.maximum(up, 0)]) ** 2).sum(axis=1))
    return order, np.where(np.arange(n) == 0, -1, place[np.maximum(up, 0)]), np.where(np.arange(n) == 0, 0.0, edges)


def anchor_trees(anchors: DataFrame, scale: int) -> DataFrame:
    """Rows of `TREE_SCHEMA`: trees of at most `TREE` anchors and PASS_VALUES components (or one anchor), from (id, label, v)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch, scale)
            data = [x.flat[s : s + n].tobytes() for s, n in zip(x.starts, x.lengths, strict=True)]
            ids = pa.array(x.ids, pa.int64(), mask=x.no_id)
            yield pa.RecordBatch.from_arrays([ids, pa.array(x.labels, pa.string()), pa.array(x.lengths, pa.int64()), pa.array(sign_codes(x), pa.int64()), pa.array(data, pa.binary())], names=["id", "label", "n", "code", "data"])

    def tree(key: int, held: list[tuple]) -> pa.RecordBatch:
        width = max(len(d) for _, _, d in held) // 8
        a = np.zeros((len(held), width))
        for i, (_, _, d) in enumerate(held):
            a[i, : len(d) // 8] = np.frombuffer(d)
        order, parents, edges = spanning_tree(a)
        row = {"tree": key, "ids": [held[i][0] for i in order], "labels": [held[i][1] for i in order], "parents": parents.tolist(), "edges": edges.tolist(), "width": width, "data": a[order].tobytes()}
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, width = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "data")), strict=True):
                wide = max(width, len(row[2]) // 8)
                if held and (len(held) == TREE or (len(held) + 1) * wide > PASS_VALUES):
                    yield tree(key, held)
                    key, held, wide = key + 1, [], len(row[2]) // 8
                held.append(row)
                width = wide
        if held:
            yield tree(key, held)

    rows = anchors.mapInArrow(coded, "id long, label string, n long, code long, data binary")
    keys = ["n", "code", F.xxhash64("id", "data")]
    parts = max(1, -(-anchors.count() // TREE))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).coalesce(parts).mapInArrow(grown, TREE_SCHEMA)


@dataclass
class Tree:
    first: int  # number of its first anchor in the pass
    parents: list[int]
    edges: list[float]
    a: np.ndarray
    norms2: np.ndarray


@dataclass
class Pass:
    """Anchors of a pass and what is asked of them: for each slot of an anchor the scores from `lo` to `hi` of rows that have its
    label (`same`) or another, the best `k` of them."""

    trees: list[Tree]
    ids: list[int | None]
    labels: list[str]
    same: bool
    k: int
    lo: np.ndarray
    hi: np.ndarray
    positives: list[list[tuple[int | None, int]]]


def passes(trees: DataFrame) -> Iterator[Pass]:
    """Trees in passes of bounded size, read by the driver a pass at a time."""
    held = Pass([], [], [], True, 0, np.empty(0), np.empty(0), [])
    values = 0
    for row in trees.toLocalIterator():
        n = len(row["ids"])
        if held.ids and (len(held.ids) + n > PASS_ANCHORS or values + n * row["width"] > PASS_VALUES):
            yield held
            held, values = Pass([], [], [], True, 0, np.empty(0), np.empty(0), []), 0
        a = np.frombuffer(bytes(row["data"])).reshape(n, row["width"])
        held.trees.append(Tree(len(held.ids), row["parents"], row["edges"], a, (a * a).sum(axis=1)))
        held.ids += row["ids"]
        held.labels += row["labels"]
        values += a.size
    if held.ids:
        yield held


# --- scans --------------------------------------------------------------------------------------------------------


def joined(lo: np.ndarray, hi: np.ndarray) -> list[tuple[float, float]]:
    """The windows that aren't empty, joined where they overlap."""
    out: list[tuple[float, float]] = []
    for a, b in sorted((a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a <= b):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Best:
    """The best k of each slot of each anchor so far; `lo` rises to the k-th of them."""

    def __init__(self, asked: Pass):
        self.asked, self.lo = asked, asked.lo.copy()
        self.rows: dict[tuple[int, int], list[tuple[int, bool, int]]] = {}
        self.windows = [joined(lo, hi) for lo, hi in zip(asked.lo, asked.hi, strict=True)]

    def add(self, anchor: int, exact: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        risen = False
        for slot in range(self.lo.shape[1]):
            lo, hi = self.lo[anchor, slot], self.asked.hi[anchor, slot]
            if lo > hi or not len(at := np.flatnonzero((exact >= lo) & (exact <= hi))):
                continue
            if len(at) > self.asked.k:
                at = at[np.lexsort((ids[at], no_id[at], -exact[at]))[: self.asked.k]]
            held = self.rows.get((anchor, slot), [])
            held = sorted(held + [(-int(exact[i]), bool(no_id[i]), int(ids[i])) for i in at])[: self.asked.k]
            self.rows[anchor, slot] = held
            if len(held) == self.asked.k and -held[-1][0] > lo:
                self.lo[anchor, slot], risen = -held[-1][0], True
        if risen:
            self.windows[anchor] = joined(self.lo[anchor], self.asked.hi[anchor])

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.rows)
        for start in range(0, len(keys), 2000):
            rows = []
            for anchor, slot in keys[start : start + 2000]:
                told = self.asked.positives[anchor][slot] if self.asked.positives else (None, None)
                rows += [(anchor, slot, self.asked.ids[anchor], *told, None if no_id else i, -s) for s, no_id, i in self.rows[anchor, slot]]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND_SCHEMA.split(", ")])


def scan_block(x: Vectors, at: slice, asked: Pass, best: Best, codes: dict[str, int], anchor_codes: list[int]) -> int:
    """Meets the rows `at` of `x` with all trees; returns how many scores were computed."""
    norms2 = x.norms2[at]
    norms, ids, no_id = np.sqrt(norms2), x.ids[at], x.no_id[at]
    labels = np.array([codes.get(y, -1) for y in x.labels[at]])
    wanted = functools.cache(lambda code: (labels == code) == asked.same)
    most, done = float(norms2.max(initial=0)), 0
    for tree in asked.trees:
        rows = x.matrix(tree.a.shape[1], at)
        mid, off = [], []
        for i, (parent, edge) in enumerate(zip(tree.parents, tree.edges, strict=True)):
            anchor = tree.first + i
            want, greatest = wanted(anchor_codes[anchor]), most * float(tree.norms2[i])
            if parent < 0:
                exact = scores(rows, tree.a[i], greatest)
                c, r, need = exact.astype(np.float64), np.zeros(len(rows)), np.flatnonzero(want)
                done, exact = done + len(rows), exact[need]
            else:
                # The last terms are above what doubles lose.
                c, r = mid[parent], (off[parent] + edge * norms) * (1 + 1e-9) + 1 + 1e-15 * norms * float(tree.norms2[i]) ** 0.5
                meets = np.zeros(len(rows), bool)
                for lo, hi in best.windows[anchor]:
                    meets |= (c + r >= lo) & (c - r <= hi)
                need = np.flatnonzero(meets & want)
                if len(need):
                    exact = scores(rows[need], tree.a[i], greatest)
                    c, done = c.copy(), done + len(need)
                    c[need], r[need] = exact, 0
            mid.append(c)
            off.append(r)
            if len(need):
                best.add(anchor, exact, ids[need], no_id[need])
    return done


def scanned(rows: DataFrame, asked: Pass, scale: int) -> DataFrame:
    """`FOUND_SCHEMA`: of each slot of each anchor the best k among all `rows` (id, label, v), ranked by `rank`."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best, codes = Best(asked), {y: i for i, y in enumerate(dict.fromkeys(asked.labels))}
        anchor_codes = [codes[y] for y in asked.labels]
        for batch in batches:
            x = vectors_of(batch, scale)
            for start in range(0, len(x), BLOCK):
                scan_block(x, slice(start, start + BLOCK), asked, best, codes, anchor_codes)
        yield from best.batches()

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.mapInArrow(run, FOUND_SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k)


def with_floors(rows: DataFrame, asked: Pass, scale: int) -> Pass:
    """`asked` with `lo` risen to the k-th best among a few rows, which the k-th best of all can't be below."""
    few = scanned(rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(SEED)) == 0), asked, scale)
    for r in few.where(F.col("rank") == asked.k).select("anchor", "slot", "score").collect():
        asked.lo[r["anchor"], r["slot"]] = r["score"]
    return asked


def find_positives(rows: DataFrame, asked: Pass, scale: int, n_positives: int) -> list[list[tuple[int | None, int]]]:
    """Of each anchor (id, score) of its best other rows of its label."""
    asked.same, asked.k = True, n_positives + 1  # the anchor itself may be among them
    asked.lo, asked.hi = np.full((len(asked.ids), 1), LEAST), np.full((len(asked.ids), 1), MOST)
    found: list[list[tuple[int | None, int]]] = [[] for _ in asked.ids]
    for r in scanned(rows, with_floors(rows, asked, scale), scale).orderBy("anchor", "rank").select("anchor", "id", "score").collect():
        found[r["anchor"]].append((r["id"], r["score"]))
    for tree in asked.trees:
        for i, own in enumerate(scores(tree.a[i : i + 1], tree.a[i], float(n) ** 2)[0] for i, n in enumerate(tree.norms2)):
            at = tree.first + i
            # Rows of one id and score are alike here, so any of them stands for the anchor itself.
            if (itself := (asked.ids[at], int(own))) in found[at]:
                found[at].remove(itself)
            del found[at][n_positives:]
    return found


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `is_anchor`.

    Components are quantised to floor(scale * x). A negative of a positive has low * positive_score <= 100 * negative_score
    <= high * positive_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = named.where("label is not null and v is not null")
    rounds, paths, spark = Rounds(vectors.sparkSession), [], vectors.sparkSession
    trees = rounds.put("trees", anchor_trees(rows.where("anchor").drop("anchor"), scale))
    rows = rows.drop("anchor")
    for asked in passes(trees):
        asked.positives = find_positives(rows, asked, scale, n_positives)
        asked.same, asked.k = False, n_negatives
        asked.lo = np.ones((len(asked.ids), n_positives), np.int64)
        asked.hi = np.zeros((len(asked.ids), n_positives), np.int64)
        for at, found in enumerate(asked.positives):
            for slot, (_, score) in enumerate(found):
                asked.lo[at, slot], asked.hi[at, slot] = -(-low * score // 100), high * score // 100
        found = scanned(rows, with_floors(rows, asked, scale), scale)
        found = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        paths.append(rounds.path(f"pass{len(paths)}", found))
    rounds.close(*rounds.held.keys() - {"trees"})
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

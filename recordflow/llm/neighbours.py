"""Operator 5: nearest neighbours by stable projections and kd-trees.

Vectors are projected onto a few Gaussian directions. The Gaussian distribution is
2-stable: for a vector at distance d, the squared projected distance over d squared
follows a chi-square law with as many degrees of freedom as there are directions.
A kd-tree over the projections yields a query's projected neighbours one leaf after the
other, the nearest first; each is verified on the original vectors, until the chance that any vector
nearer than the k-th best so far lies as far away as the next leaf is small: the chi-square
distribution function at (projected distance / k-th distance) squared reaches
``confidence``. Projected distances are taken less a bound of their rounding, so at a k-th
distance of 0 the search goes on through every leaf that can hold a copy.

The tree's upper part is cut from a bounded sample of the projections and cuts the table
into cells; each vector lies in one cell, which has the lower part. A query first searches the cell it lies
in. Its k-th distance there decides, by the same test, which other cells can matter, and only to these
it is sent, with that distance as a bound.

Copies of a vector are one point with the k + 1 least ids, before anything is
shuffled, and equal queries are asked once, so hot vectors load no cell.

Defined results: vectors that are null, zero, or have null or non-finite components,
and rows without an id, take no part; a vector whose length differs from the query's
is no candidate; equal distances are ordered by id; a query's own rows (those with its
id) are not candidates, and repeated candidate rows count once for each id, the nearest;
fewer candidates than k give fewer rows; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, materialise, partitions

POINTS = "vec_id long, vector array<double>, asks long, cell int, bound double"
FOUND = "asks long, vec_id long, score double"
HELD = 16_384  # vectors that a task gathers before it makes copies one


@dataclass(frozen=True)
class Search:
    k: int = 10
    directions: int = 8
    confidence: float = 0.95
    leaf: int = 32
    least_block: int = 4096  # vectors of a cell, about: a 200th of all, within these bounds
    most_block: int = 262_144
    sample: int = 16_384  # projections that the upper part of the tree is cut from
    seed: int = 7


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """The chi-square distribution function, for an even number of degrees."""
    if degrees % 2:
        raise ValueError("the number of directions must be even")
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(degrees // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def directions(size: int, search: Search) -> np.ndarray:
    """Gaussian directions for vectors of a size; the same everywhere."""
    return np.random.default_rng((search.seed, size)).standard_normal((size, search.directions))


class KdTree:
    """Median cuts along the widest side, down to leaves of ``leaf`` points; a node has its side, its cut and two nodes below."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple[int, float, float, int, int]] = []  # side, highest of the lower half, lowest of the upper half, and nodes; a leaf: -1 and its number
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            own, above, upper = todo.pop()
            if above >= 0:
                node = list(self.nodes[above])
                node[3 + upper] = len(self.nodes)
                self.nodes[above] = tuple(node)
            spread = np.ptp(points[own], axis=0) if len(own) > leaf else None
            if spread is None or spread.max() <= 0:
                self.nodes.append((-1, 0.0, 0.0, len(self.leaves), 0))
                self.leaves.append(own)
                continue
            side = int(np.argmax(spread))
            middle = len(own) // 2
            order = own[np.argpartition(points[own, side], middle)]
            low, high = order[:middle], order[middle:]
            todo += [(low, len(self.nodes), 0), (high, len(self.nodes), 1)]
            self.nodes.append((side, float(points[low, side].max()), float(points[high, side].min()), 0, 0))

    def nearest_first(self, q: np.ndarray, slack: float) -> Iterator[tuple[float, int]]:
        """Leaves in order of their squared projected distance from q (less what rounding can make of it), with that distance.

        A node's distance is made of one gap a side: going to the far half of a cut widens the gap of its side alone.
        """
        heap: list[tuple[float, int, tuple[float, ...]]] = [(0.0, 0, (0.0,) * len(q))]
        at = q.tolist()
        while heap:
            far, node, gaps = heapq.heappop(heap)
            side, low, high, a, b = self.nodes[node]
            if side < 0:
                yield far, a
                continue
            for gap, below in ((at[side] - low - slack, a), (high - at[side] - slack, b)):
                if gap > gaps[side]:
                    heapq.heappush(heap, (far + gap * gap - gaps[side] ** 2, below, (*gaps[:side], gap, *gaps[side + 1 :])))
                else:
                    heapq.heappush(heap, (far, below, gaps))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose half of each cut a point lies in: the lower one up to and with its highest."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            side, low, _, a, b = self.nodes[node]
            if side < 0:
                out[own] = a
                continue
            under = points[own, side] <= low
            todo += [(below, some) for below, some in ((a, own[under]), (b, own[~under])) if len(some)]
        return out

    def halved(self) -> KdTree:
        """The tree as one of all space: the upper half of a cut begins where the lower one ends."""
        self.nodes = [(side, low, low, a, b) for side, low, _, a, b in self.nodes]
        return self


class Distinct:
    """The distinct vectors of a block, and the ids of each that can be among the k nearest of a query.

    Copies are equally far from any query, so of theirs only the k least ids other than
    the query's can be, ids that are nearer by another vector included: k + 1 are kept.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        vectors = np.ascontiguousarray(vectors + 0.0)  # -0.0 is 0.0
        order = np.argsort(vectors.view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), kind="stable")
        new = np.ones(len(order), bool)
        for at in range(1, len(order), 8192):
            here = slice(at, at + 8192)
            new[here] = (vectors[order[here]] != vectors[order[at - 1 : at + 8191][: len(order[here])]]).any(axis=1)
        group, own = np.cumsum(new) - 1, ids[order]
        by = np.lexsort((own, group))
        group, own = group[by], own[by]
        once = np.ones(len(own), bool)
        once[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        group, own = group[once], own[once]
        keep = np.arange(len(own)) - np.searchsorted(group, group) <= k
        self.vectors, self.ids = vectors[order[new]], own[keep]
        self.first = np.searchsorted(group[keep], np.arange(len(self.vectors) + 1))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these vectors, and the place in ``rows`` of each."""
        if len(self.ids) == len(self.vectors):
            return self.ids[rows], np.arange(len(rows))
        many = self.first[rows + 1] - self.first[rows]
        place = np.repeat(np.arange(len(rows)), many)
        return self.ids[np.arange(len(place)) + (self.first[rows] - (np.cumsum(many) - many))[place]], place


def is_done(far: float, kth: float, search: Search) -> bool:
    """Whether nothing nearer than the k-th distance is likely at a squared projected distance."""
    if kth <= 0:
        return far > 0
    return bool(chi_square_cdf(np.array(far / kth**2), search.directions) >= search.confidence)


def rounding(norms: np.ndarray | float, to: np.ndarray) -> np.ndarray | float:
    """How far off projections of vectors of these norms, taken together, can be by rounding."""
    return 2 * len(to) * np.finfo(float).eps * norms * np.sqrt((to * to).sum(axis=0).max())  # dot products round by less than size * eps * both norms


class Cell:
    """Vectors of one length, with the lower part of the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, search: Search):
        self.search, self.to = search, directions(vectors.shape[1], search)
        self.block = Distinct(ids, vectors, search.k)
        self.tree = KdTree(self.block.vectors @ self.to, search.leaf)
        self.norm = np.sqrt((self.block.vectors**2).sum(axis=1).max())

    def nearest(self, q: np.ndarray, but: int | None, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids other than ``but`` and distances of the k nearest that are no farther than ``bound``."""
        vectors, best_ids, best = self.block.vectors, np.zeros(0, np.int64), np.zeros(0)
        kth, held, many = bound, [], 0
        leaves = self.tree.nearest_first(q @ self.to, float(rounding(self.norm + np.sqrt(q @ q), self.to)))
        wanted = 2 * k
        for far, leaf in leaves:
            if (done := is_done(far, kth, self.search)) and not held:
                break
            if not done:
                held.append(self.tree.leaves[leaf])
                many += len(held[-1])
                if many < wanted:
                    continue
            rows, held, many, wanted = np.concatenate(held), [], 0, min(2 * wanted, 512)
            best_ids, best = self._verified(rows, q, but, k, kth, best_ids, best)
            if len(best) == k:
                kth = min(kth, best[-1])
            if done and is_done(far, kth, self.search):
                break
        if held:
            best_ids, best = self._verified(np.concatenate(held), q, but, k, kth, best_ids, best)
        return best_ids, best

    def _verified(self, rows: np.ndarray, q: np.ndarray, but: int | None, k: int, kth: float, best_ids: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = self.block.vectors[rows] - q
        distance = np.sqrt((gap * gap).sum(axis=1))
        near = distance <= kth
        if not near.any():
            return best_ids, best
        rows, distance = rows[near], distance[near]
        own, place = self.block.of(rows)
        if but is not None:
            other = own != but
            own, place = own[other], place[other]
        return smallest(np.concatenate([best_ids, own]), np.concatenate([best, distance[place]]), k)


def nearest_in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, search: Search) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query, ids and distances of its nearest among the vectors, other than its own."""
    cell = Cell(ids, vectors, search)
    for query_id, q in zip(query_ids, queries, strict=True):
        yield query_id, *cell.nearest(q, query_id, search.k)


def smallest(ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, ties to smaller ids, each id once."""
    order = np.lexsort((ids, distance))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], distance[order]


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """vec_id and vector of the rows that take part; -0.0 is 0.0."""
    v = F.transform(F.col(vector_name).cast("array<double>"), lambda x: x + F.lit(0.0))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_name).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(good)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    return np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy()


def by_length(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of vectors of one length, and these as a matrix."""
    start = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        yield of, values[start[of][:, None] + np.arange(size)]


def fewer_copies(own: DataFrame, search: Search) -> DataFrame:
    """vec_id, vector, point: of copies that a task meets together, the k + 1 least ids; with the projection of each."""

    def flush(ids: list, sizes: list, values: list) -> Iterator[pa.RecordBatch]:
        ids, sizes, values = np.concatenate(ids), np.concatenate(sizes), np.concatenate(values)
        for of, vectors in by_length(ids, sizes, values):
            d = Distinct(ids[of], vectors, search.k)
            found, place = d.of(np.arange(len(d.vectors)))
            points = d.vectors @ directions(vectors.shape[1], search)
            for at in range(0, len(found), 1024):
                here = place[at : at + 1024]
                matrix = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * m.shape[1]), pa.array(m[here].ravel()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 1024]), matrix(d.vectors), matrix(points)], ["vec_id", "vector", "point"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                for column, more in zip(held, (part.column("vec_id").to_numpy(), *_lists(part, "vector")), strict=True):
                    column.append(more)
            if sum(map(len, held[0])) >= HELD:
                yield from flush(*held)
                held = ([], [], [])
        if held[0]:
            yield from flush(*held)

    return own.mapInArrow(run, "vec_id long, vector array<double>, point array<double>")


def placed(rows: DataFrame, tree: KdTree) -> DataFrame:
    """The rows (vec_id, vector, asks, point, bound) with the cell that each lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _lists(batch, "point")[1].reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "asks")), pa.array(tree.leaf_of(points)), batch.column("bound")], ["vec_id", "vector", "asks", "cell", "bound"])

    return rows.mapInArrow(run, POINTS)


def other_cells(rows: DataFrame, tree: KdTree, search: Search) -> DataFrame:
    """The rows once for each cell but their own that the test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, values = _lists(batch, "vector")
            points = _lists(batch, "point")[1].reshape(batch.num_rows, -1)
            own, bound = tree.leaf_of(points), batch.column("bound").to_numpy()
            ends = np.cumsum(sizes)
            for i, q in enumerate(points):
                v = values[ends[i] - sizes[i] : ends[i]]
                slack = float(rounding(2 * np.sqrt(v @ v) + 2 * bound[i], directions(len(v), search))) if np.isfinite(bound[i]) else 0.0
                cells = []
                for far, cell in tree.nearest_first(q, slack):
                    if is_done(far, bound[i], search):
                        break
                    if cell != own[i]:
                        cells.append(cell)
                if cells:
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(cells), np.int64)))
                    yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("vec_id", "vector", "asks")), pa.array(cells, pa.int32()), one.column("bound")], ["vec_id", "vector", "asks", "cell", "bound"])

    return rows.mapInArrow(run, POINTS)


def searched(there: DataFrame, asked: DataFrame, parts: int, search: Search) -> DataFrame:
    """Of each row that asks the k + 1 nearest in its cell, no farther than its bound."""
    sizes = F.size("vector").alias("size")
    dealt = there.unionByName(asked).withColumn("size", sizes).repartition(parts, "size", "cell").sortWithinPartitions("size", "cell", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, ([], []), None
        for batch in batches:
            ids, asks, cells, bounds = (batch.column(c).to_numpy() for c in ("vec_id", "asks", "cell", "bound"))
            lengths, values = _lists(batch, "vector")
            ends = np.cumsum(lengths)
            key = lengths.astype(np.int64) << 32 | cells
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != now:
                    now, held, cell = key[a], ([], []), None
                vectors = values[ends[a] - lengths[a] : ends[b - 1]].reshape(b - a, -1)
                plain = asks[a:b] < 0  # these stand first in a cell
                if plain.any():
                    held[0].append(ids[a:b][plain])
                    held[1].append(vectors[plain])
                if not plain.all() and held[0]:
                    cell = cell or Cell(np.concatenate(held[0]), np.concatenate(held[1]), search)
                    for i in np.flatnonzero(~plain):
                        found, far = cell.nearest(vectors[i], None, search.k + 1, bounds[a + i])
                        if len(found):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), asks[a + i])), pa.array(found), pa.array(far)], ["asks", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, is_query, search: Search = Search(), id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query row (a condition on vec_id)."""
    spark = vectors.sparkSession
    own = usable(vectors, id_name, vector_name)
    stored = materialise(fewer_copies(own, search), "vectors")
    queries = own.where(is_query(F.col("vec_id")))
    asked = materialise(fewer_copies(queries.groupBy("vector").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vector"), search).withColumn("asks", F.monotonically_increasing_id()).withColumn("bound", F.lit(float("inf"))), "queries")
    with freeing(spark):
        n = stored.count()
        some = stored.select("point").orderBy(F.xxhash64("vec_id", "point")).limit(search.sample).collect()  # search.sample rows
    cells = max(1, n // min(max(n // 200, search.least_block), search.most_block))
    points = np.array([r["point"] for r in some]).reshape(len(some), search.directions)
    tree = KdTree(np.unique(points, axis=0), -(-len(points) // cells) if len(points) else 1).halved()
    there = placed(stored.withColumns({"asks": F.lit(-1).cast("long"), "bound": F.lit(0.0)}), tree)
    parts = max(partitions(spark), len(tree.leaves))
    home = materialise(searched(there, placed(asked, tree), parts, search), "found")
    found = home
    if len(tree.leaves) > 1:
        kth = home.groupBy("asks").agg(F.count("*").alias("many"), F.max("score").alias("far"))
        bounded = asked.drop("bound").join(kth, "asks", "left").withColumn("bound", F.when(F.col("many") > search.k, F.col("far")).otherwise(F.lit(float("inf")))).select(*asked.columns)
        found = home.unionByName(searched(there, other_cells(bounded, tree, search), parts, search))
    by = lambda key: Window.partitionBy(key).orderBy("score", "vec_id")
    each = found.groupBy("asks", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(by("asks"))).where(F.col("rank") <= search.k + 1).drop("rank")
    told = each.join(asked.select("asks", "vector"), "asks")
    answers = queries.select(F.col("vec_id").alias("query_id"), "vector").distinct().join(told, "vector").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return answers.withColumn("rank", F.row_number().over(by("query_id"))).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")

"""Nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking.

The trees are grown on a bounded sample; every vector is then routed to one leaf of each tree. A query walks all
trees through one queue, nearest margin first, until the leaves it has met hold enough vectors; those are
compared with it exactly. How many are enough is measured: a bounded number of queries is first answered by brute
force, and the walk goes as far as it takes to meet the wanted part of their true neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from esquina.operators.stage import settle

TREES = 16
SAMPLE_ROWS = 32_768  # vectors that the trees are grown on, at most
LEAF_ROWS = 128  # sampled vectors in a leaf, at most
DIRECTIONS = 32  # random directions of which a split takes the one that spreads its vectors most
RECALL = 0.97  # wanted part of the true neighbours of the pilot queries
PILOTS = 64  # queries that are compared with every vector to measure how far the others have to walk
LEAST_CANDIDATES = 4_000
BLOCK_ROWS = 4_096  # vectors of one leaf that one task compares


@dataclass
class Tree:
    """Inner nodes by number; a child below zero is leaf ``-child - 1``."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]).astype(int)
            at[inner] = self.children[node, side]
        return -at - 1


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits at the median along a random direction; vectors that no direction tells apart share a leaf."""
    normals, offsets, children, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(x)), None)]
    while todo:
        rows, parent = todo.pop()
        number = None
        if len(rows) > leaf:
            directions = rng.normal(size=(DIRECTIONS, x.shape[1]))
            directions /= np.linalg.norm(directions, axis=1)[:, None]
            some = rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)
            normal = directions[np.argmax((x[some] @ directions.T).var(0))]
            along = x[rows] @ normal
            cut = float(np.median(along))
            right = along > cut
            if 0 < right.sum() < len(rows):
                number = len(normals)
                normals.append(normal)
                offsets.append(cut)
                children.append([0, 0])
                todo += [(rows[~right], (number, 0)), (rows[right], (number, 1))]
        if number is None:
            leaves += 1
            number = -leaves
        if parent:
            children[parent[0]][parent[1]] = number
    size = x.shape[1]
    return Tree(np.array(normals).reshape(-1, size), np.array(offsets), np.array(children, np.int64).reshape(-1, 2))


def probes(forest: list[Tree], held: list[np.ndarray], query: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Leaves of all trees, the least sum of squared margins on the way first, until they hold ``enough`` vectors.

    A vector counts once for each tree in which its leaf is met.
    """
    queue = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    margins = [tree.normals @ query - tree.offsets for tree in forest]
    found, total = [], 0
    while queue and total < enough:
        far, t, at = heapq.heappop(queue)
        while at >= 0:
            margin = margins[t][at]
            near = int(margin > 0)
            heapq.heappush(queue, (far + margin * margin, t, int(forest[t].children[at, 1 - near])))
            at = int(forest[t].children[at, near])
        found.append((t, -at - 1))
        total += int(held[t][-at - 1])
    return found


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def plant(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE_ROWS, leaf: int = LEAF_ROWS) -> list[Tree]:
    """The forest, grown on the ``sample`` vectors with the least hash of their ids: a bound, whatever the table's size."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample).select("vector").toArrow()
    if not chosen.num_rows:
        return []
    x = matrix(chosen.column(0).combine_chunks())
    return [grow(x, leaf, np.random.default_rng(t)) for t in range(trees)]


def leaf_numbers(vectors: DataFrame, forest: list[Tree]) -> DataFrame:
    """``vectors`` with ``leaves``, the vector's leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vector"))
                leaves = np.stack([tree.leaves(x) for tree in forest], axis=1)
                columns = [*b.columns, pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "leaves"])

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, query boolean, leaves array<int>")


def nearest_in_block(k: int):
    """For each query of a block of one leaf, its ``k`` nearest there, by exact distances summed in order."""

    def run(key: tuple, s: pa.Table, q: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.empty((3, 0))]
        if s.num_rows:
            ids, x = s.column("vec_id").to_numpy(), matrix(s.column("vector").combine_chunks())
            square = (x * x).sum(1)
        for part in q.combine_chunks().to_batches(max_chunksize=256) if s.num_rows else []:
            y = matrix(part.column("asked"))
            rough = square[None, :] - 2 * (y @ x.T) + (y * y).sum(1)[:, None]
            for query_id, one, about in zip(part.column("query_id").to_pylist(), y, rough):
                last = min(k, len(about) - 1)
                limit = np.partition(about, last)[last]
                near = np.flatnonzero((about <= limit + 1e-9 * (1 + abs(limit))) & (ids != query_id))
                total = np.zeros(len(near))
                for j in range(x.shape[1]):
                    total += (x[near, j] - one[j]) ** 2
                score = np.sqrt(total)
                best = np.lexsort((ids[near], score))[:k]
                found.append(np.stack([np.full(len(best), query_id, np.int64), ids[near][best], score[best].view(np.int64)]))
        query_ids, vec_ids, bits = np.concatenate([f.astype(np.int64, copy=False) for f in found], axis=1)
        columns = [pa.array(query_ids), pa.array(vec_ids), pa.array(np.ascontiguousarray(bits).view(np.float64))]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return run


def true_neighbours(numbered: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``pilot, score, leaves``: the ``k`` nearest of each row of ``queries`` among all vectors, by one pass over them.

    A task hands on ``k`` rows for a pilot at most.
    """
    square = (queries * queries).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, leaves = np.full((len(queries), 0), np.inf), np.empty((len(queries), 0), object)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"))
            far = square[:, None] - 2 * (queries @ x.T) + (x * x).sum(1)[None, :]
            far[ids[:, None] == b.column("vec_id").to_numpy()[None, :]] = np.inf
            own = np.empty(b.num_rows, object)
            own[:] = b.column("leaves").to_pylist()
            scores = np.concatenate([scores, far], axis=1)
            leaves = np.concatenate([leaves, np.broadcast_to(own, far.shape)], axis=1)
            best = np.argsort(scores, axis=1)[:, :k]
            scores, leaves = np.take_along_axis(scores, best, 1), np.take_along_axis(leaves, best, 1)
        pilot, place = np.nonzero(np.isfinite(scores))
        columns = [pa.array(pilot.astype(np.int32)), pa.array(scores[pilot, place])]
        columns.append(pa.array(list(leaves[pilot, place]), pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["pilot", "score", "leaves"])

    found = numbered.select("vec_id", "vector", "leaves").mapInArrow(run, "pilot int, score double, leaves array<int>")
    rank = F.row_number().over(Window.partitionBy("pilot").orderBy("score"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def measured_walk(
    numbered: DataFrame, forest: list[Tree], held: list[np.ndarray], k: int, recall: float, pilots: int
) -> int:
    """How many vectors the leaves of a walk have to hold to meet ``recall`` of the pilots' true neighbours.

    The pilots are the ``pilots`` queries with the least hash of their ids; at most ``pilots * k`` rows are collected.
    """
    chosen = numbered.filter("query").orderBy(F.xxhash64("vec_id", F.lit("pilot")), "vec_id").limit(pilots)
    asked = chosen.select("vec_id", "vector").toArrow().combine_chunks()
    if not asked.num_rows:
        return 0
    queries = matrix(asked.column("vector").combine_chunks())
    true = true_neighbours(numbered, asked.column("vec_id").to_numpy(), queries, k).collect()
    needed = []
    for pilot, query in enumerate(queries):
        met, total = {}, 0
        for t, leaf in probes(forest, held, query, np.inf):
            total += 1  # a walk that shall meet this leaf has not enough before it
            met[t, leaf] = total
            total += int(held[t][leaf]) - 1
        needed += [min(met[t, leaf] for t, leaf in enumerate(r["leaves"])) for r in true if r["pilot"] == pilot]
    if not needed:
        return 0
    needed.sort()
    return needed[min(len(needed), math.ceil(recall * len(needed))) - 1]


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = TREES,
    sample: int = SAMPLE_ROWS,
    leaf: int = LEAF_ROWS,
    recall: float = RECALL,
    pilots: int = PILOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each query row, ties to the smaller id.

    Vectors that are null, zero or hold a null or non-finite component, rows without an id, and vectors of another
    dimension than the first by id take no part. ``recall`` is reached on the ``pilots`` and, as far as these are like them,
    by the other queries: near it on average, whatever the vectors look like; those without any structure make every query
    walk most of the table. Rows that repeat an id count once, by their least vector. A query
    that has visited every leaf has an exact answer. The forest in the tasks is bounded by ``sample``; a leaf that holds
    more than ``BLOCK_ROWS`` vectors is compared in blocks, each of which hands on ``k`` rows for a query at most.
    """
    names = ["query_id", "rank", "vec_id", "score"]
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("query"))
    good = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    once = good.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("query").alias("query"))
    dimension = F.size("vector")
    first = once.orderBy("vec_id").limit(1).select(dimension.alias("d")).first()
    vectors = settle(once.filter(dimension == (first["d"] if first else 0)), "vectors")
    forest = plant(vectors, trees, sample, leaf)
    spark = table.sparkSession
    if not forest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    numbered = settle(leaf_numbers(vectors.select("vec_id", "vector", "query"), forest), "leaves")
    spread = numbered.select("vec_id", F.posexplode("leaves").alias("tree", "leaf"))
    counts = spread.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()  # one row per leaf of the bounded forest
    held = [np.zeros(len(t.children) + 1, np.int64) for t in forest]
    for r in counts:
        held[r["tree"]][r["leaf"]] = r["n"]
    enough = max(LEAST_CANDIDATES, measured_walk(numbered, forest, held, k, recall, pilots))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            for i, vector in enumerate(matrix(b.column("vector")) if b.num_rows else []):
                met = probes(forest, held, vector, enough)
                out = [(t, leaf, block) for t, leaf in met for block in range(-(-int(held[t][leaf]) // BLOCK_ROWS))]
                same = [b.column(c).take(pa.array([i] * len(out), pa.int32())) for c in ("vec_id", "vector")]
                parts = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*parts, *same], ["tree", "leaf", "block", "query_id", "asked"])

    asked = numbered.filter("query").select("vec_id", "vector")
    visits = asked.mapInArrow(walk, "tree int, leaf int, block int, query_id long, asked array<double>")
    sizes = F.array(*[F.array(*[F.lit(int(-(-n // BLOCK_ROWS)) or 1) for n in h]) for h in held])
    stored = numbered.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    blocks = F.get(F.get(sizes, F.col("tree")), F.col("leaf"))
    stored = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    keys = ["tree", "leaf", "block"]
    near = stored.groupBy(*keys).cogroup(visits.groupBy(*keys))
    scored = near.applyInArrow(nearest_in_block(k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*names)

"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors fall into cells by the nearest of up to CELLS centroids, which are fitted on a sample of SAMPLE rows (those with
the least hashes of vec_id), and a cell is dealt to shards of bounded size by a hash of vec_id.  Every row is indexed.  A
shard's task builds its graph in batches: a batch's points descend through the levels as a search does, search the graph
so far, all at once, and are linked with diverse near points of what they found and of their own batch.  A graph is
stored as one row of flat arrays: ids, vectors, levels and, for each level, a matrix of neighbour numbers.

A query is searched in the shards of the cells whose centroids are nearest to it.  How many cells that takes is measured:
the exact neighbours of TRIALS queries are found by brute force, in one pass, and as many cells are searched as hold
COVERAGE of them; where vectors have no structure that is all of them.  Shards are searched by blocks of queries, and
the shards' best are ranked by exact cosines of the original vectors in double precision.

Equal vectors of a shard are one point of its graph, which returns as many of their ids as wanted, least first, so
copies neither crowd the graph nor hide each other.

Defined results: vectors that are null, of zero length, or hold null or non-finite components neither search nor are
found, as are rows without vec_id; a vector of another dimension than the query's is not found by it (cells are those of
the sample's commonest dimension, other dimensions have one each); ties go to the smaller vec_id; no row with the query's
vec_id is its neighbour; rows that repeat a query with an equal vector are one query, with another vector one each; other
repeated rows are candidates each; fewer candidates than wanted give fewer rows; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvello.llm.common import discard, materialise

#: Rows of a shard: SHARD_GROWTH times the root of all rows, between these; queries of a block on average.
LEAST_SHARD, MOST_SHARD, SHARD_GROWTH, QUERIES = 4096, 65_536, 16, 2048
#: Cells at most; rows and numbers of the sample they are fitted on; rounds of fitting.
CELLS, SAMPLE, SAMPLE_NUMBERS, ROUNDS = 256, 8192, 1 << 21, 10
#: Queries whose neighbours are found by brute force, and the share of these that the searched cells hold.
TRIALS, COVERAGE = 100, 0.98
LINKS, BUILD_WIDTH, SEARCH_WIDTH, DESCENT_WIDTH = 16, 64, 96, 4
BATCH = 256


class Level:
    """One level: the points on it and their neighbours' numbers on it, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, links: int) -> None:
        self.points, self.links = points, links
        self.near = np.full((len(points), links), -1, np.int32)

    def search(self, vectors: np.ndarray, wanted: np.ndarray, entry: np.ndarray, width: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """For rows of ``wanted`` the ``width`` nearest found of the first ``known`` points, by distance; -1 past the last.

        ``entry``: for each row numbers of points to begin with.
        """
        n, at = len(wanted), np.arange(len(wanted))[:, None]
        seen = np.zeros((n, known + 1), bool)  # the last column takes the marks of -1
        found = np.full((n, width), -1, np.int32)
        far = np.full((n, width), np.inf, np.float32)
        done = np.ones((n, width), bool)

        def offer(new: np.ndarray) -> None:
            nonlocal found, far, done
            new = np.where(seen[at, new], -1, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[at, new] = True
            away = 1 - np.einsum("ij,ikj->ik", wanted, vectors[self.points[new]])
            away[new < 0] = np.inf
            every, apart = np.concatenate([found, new], axis=1), np.concatenate([far, away], axis=1)
            open_ = np.concatenate([done, new < 0], axis=1)
            order = np.argsort(apart, axis=1, kind="stable")[:, :width]
            found, far, done = every[at, order], apart[at, order], open_[at, order]

        offer(entry.astype(np.int32))
        rows = np.arange(n)
        while True:
            first = np.argmin(done, axis=1)  # the nearest point that hasn't been visited
            left = ~done[rows, first]
            if not left.any():
                return found, far
            done[rows, first] = True
            near = self.near[found[rows, first]]
            near = np.where(left[:, None] & (near < known), near, -1)
            offer(near)

    def diverse(self, vectors: np.ndarray, found: np.ndarray, far: np.ndarray, links: int) -> np.ndarray:
        """Of each row's candidates (in order of distance) up to ``links``, each nearer to the row's point than to those before; then the nearest others."""
        n, width = found.shape
        held = vectors[self.points[found]]
        taken = np.zeros((n, width), bool)
        nearest = np.full((n, width), np.inf, np.float32)  # of each candidate to those taken
        count = np.zeros(n, int)
        for k in range(width):
            take = (found[:, k] >= 0) & (far[:, k] < nearest[:, k]) & (count < links)
            taken[:, k] = take
            count += take
            rows = np.flatnonzero(take)
            if len(rows) and k + 1 < width:
                apart = 1 - np.einsum("ij,ikj->ik", held[rows, k], held[rows, k + 1 :])
                nearest[rows, k + 1 :] = np.minimum(nearest[rows, k + 1 :], apart)
        rank = np.where(found < 0, 2 * width, np.where(taken, 0, width) + np.arange(width))
        order = np.argsort(rank, axis=1, kind="stable")[:, :links]
        out = np.take_along_axis(found, order, axis=1)
        return out if out.shape[1] == links else np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)

    def insert(self, vectors: np.ndarray, first: int, last: int, found: np.ndarray, far: np.ndarray) -> None:
        """Link points first to last - 1, whose nearest earlier points are given, with these and with each other."""
        own = vectors[self.points[first:last]]
        apart = (1 - own @ own.T).astype(np.float32)
        np.fill_diagonal(apart, np.inf)
        mates = np.broadcast_to(np.arange(first, last, dtype=np.int32), apart.shape)
        mates = np.where(np.isinf(apart), -1, mates)
        found, far = np.concatenate([found, mates], axis=1), np.concatenate([far, apart], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :BUILD_WIDTH]
        found, far = np.take_along_axis(found, order, axis=1), np.take_along_axis(far, order, axis=1)
        half = max(1, self.links // 2)
        chosen = self.diverse(vectors, found, far, half)
        self.near[first:last, :half] = chosen
        # And back: a point's links and those that now chose it; past the room for them the diverse ones stay.
        of = np.repeat(np.arange(first, last, dtype=np.int32), half)
        to = chosen.ravel()
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        of, to = of[order], to[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(targets), BATCH):
            some, most = targets[at : at + BATCH], int(count[at : at + BATCH].max(initial=0))
            new = np.full((len(some), most), -1, np.int32)
            for k, (b, c) in enumerate(zip(begin[at : at + BATCH], count[at : at + BATCH], strict=True)):
                new[k, :c] = of[b : b + c]
            every = np.concatenate([self.near[some], new], axis=1)
            every.sort(axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            away = (1 - np.einsum("ij,ikj->ik", vectors[self.points[some]], vectors[self.points[every]])).astype(np.float32)
            away[every < 0] = np.inf
            order = np.argsort(away, axis=1, kind="stable")
            self.near[some] = self.diverse(vectors, np.take_along_axis(every, order, axis=1), np.take_along_axis(away, order, axis=1), self.links)


class Graph:
    """The graph of unit vectors; level 0 has all of them, each higher one about a LINKS-th of the one below."""

    def __init__(self, vectors: np.ndarray, build: bool = True) -> None:
        self.vectors, n = vectors, len(vectors)
        height = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(int)
        # Points of high levels come first, so that the points of each level are the first of the one below.
        self.sizes = [n, *(int((height >= h).sum()) for h in range(1, height.max(initial=0) + 1))]
        self.levels = [Level(np.arange(size), LINKS * (1 if h else 2)) for h, size in enumerate(self.sizes)]
        if build:
            for h in reversed(range(len(self.levels))):
                self._fill(h)

    def _descended(self, wanted: np.ndarray, h: int, known: int) -> np.ndarray:
        """For rows of ``wanted`` points of level h, of the first ``known``, where a search from the top arrives."""
        entry = np.zeros((len(wanted), 1), np.int32)  # the first point is on all levels
        for level in reversed(self.levels[h + 1 :]):
            entry, _ = level.search(self.vectors, wanted, entry, DESCENT_WIDTH, min(known, len(level.points)))
        return entry

    def _fill(self, h: int) -> None:
        level = self.levels[h]
        first, size = 0, len(level.points)
        while first < size:
            last = min(size, first + max(1, min(BATCH, first // 2)))
            if first:
                wanted = self.vectors[level.points[first:last]]
                found, far = level.search(self.vectors, wanted, self._descended(wanted, h, first), BUILD_WIDTH, first)
            else:
                found, far = np.empty((last, 0), np.int32), np.empty((last, 0), np.float32)
            level.insert(self.vectors, first, last, found, far)
            first = last

    def search(self, wanted: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers of the nearest points found of each row of ``wanted``, -1 past the last."""
        n = len(self.vectors)
        return self.levels[0].search(self.vectors, wanted, self._descended(wanted, 0, n), width, n)[0]


KEY = ["dimension", "cell", "part"]
INDEX = "dimension int, cell int, part int, ids array<long>, starts array<int>, vectors binary, sizes array<int>, links binary"


def _built(rows: pd.DataFrame) -> dict:
    """Index row of a shard: distinct vectors in graph order, their ids from starts on."""
    ids, vectors = rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.float64)
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    mixed = np.random.default_rng(1).permutation(len(distinct))
    place = np.empty(len(distinct), int)
    place[mixed] = np.arange(len(distinct))
    order = np.lexsort((ids, place[of.ravel()]))
    starts = np.searchsorted(place[of.ravel()][order], np.arange(len(distinct) + 1))
    vectors = distinct[mixed]
    graph = Graph(_unit(vectors))
    return {**{k: int(rows[k].iloc[0]) for k in KEY}, "ids": ids[order], "starts": starts.astype(np.int32), "vectors": vectors.tobytes(), "sizes": np.array(graph.sizes, np.int32), "links": b"".join(x.near.tobytes() for x in graph.levels)}


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def loaded(row) -> tuple[Graph, np.ndarray]:
    """An index row's graph and its original vectors."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dimension"]))
    graph = Graph(_unit(vectors), build=False)
    graph.sizes = [int(s) for s in row["sizes"]]
    links = np.frombuffer(row["links"], np.int32)
    graph.levels, at = [], 0
    for h, size in enumerate(graph.sizes):
        level = Level(np.arange(size), LINKS * (1 if h else 2))
        level.near = links[at : at + size * level.links].reshape(size, level.links)
        at += size * level.links
        graph.levels.append(level)
    return graph, vectors


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part."""
    v = F.col("vector")
    out = rows.select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return out.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(sound)


def _numbers(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: (their numbers, matrix)."""
    lengths = column.value_lengths().to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)


class Cells:
    """Centroids of unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        unit = _unit(sample)
        distinct = np.unique(unit, axis=0)
        self.centroids = distinct[np.random.default_rng(2).permutation(len(distinct))[: max(1, n)]]
        for _ in range(ROUNDS if n > 1 else 0):
            near = (unit @ self.centroids.T).argmax(axis=1)
            for c in range(len(self.centroids)):
                if len(mine := unit[near == c]) and (total := mine.sum(axis=0)).any():
                    self.centroids[c] = total / np.linalg.norm(total)

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of each vector, nearest first."""
        if vectors.shape[1] != self.centroids.shape[1]:
            return np.zeros((len(vectors), 1), np.int64)
        return np.argsort(-(_unit(vectors) @ self.centroids.T), axis=1, kind="stable")

    def placed(self, rows: DataFrame, most: int) -> DataFrame:
        """rows (id columns, then vector) with dimension and cell, a row for each of the ``most`` nearest cells."""
        names = rows.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, vectors in _numbers(batch.column(len(names) - 1)):
                    ranked = self.ranked(vectors)[:, :most]
                    some = batch.take(pa.array(np.repeat(at, ranked.shape[1])))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(ranked.size, vectors.shape[1]), pa.int32()), pa.array(ranked.ravel(), pa.int32())], [*names, "dimension", "cell"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(place, f"{kinds}, dimension int, cell int")


def fitted(vectors: DataFrame, rows: int, shard: int) -> Cells:
    """Cells of about a shard each, CELLS at most, from the sample's vectors of the commonest dimension."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    common = sample.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return Cells(np.ones((1, 1)), 1)
    some = sample.where(F.size("vector") == common["n"]).select("vector").limit(max(CELLS, SAMPLE_NUMBERS // common["n"])).toArrow()
    matrix = some.column(0).combine_chunks().flatten().to_numpy().reshape(-1, common["n"])
    return Cells(matrix, min(CELLS, -(-rows // shard)))


def exact(rows: DataFrame, queries: list, k: int, *more: str) -> DataFrame:
    """q, vec_id, score and ``more`` columns of rows: the k nearest of each of a few queries (q, vec_id, vector), by brute force in one pass."""
    names = ["vec_id", *more, "vector"]
    frame = rows.select(*names)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, vectors in _numbers(batch.column(len(names) - 1)):
                norms = np.linalg.norm(vectors, axis=1)
                for q, own, vector in queries:
                    if len(vector) == vectors.shape[1]:
                        score = vectors @ np.array(vector) / (norms * np.linalg.norm(vector))
                        score[ids[at] == own] = -np.inf
                        top = np.lexsort((ids[at], -score))[:k]
                        top = top[np.isfinite(score[top])]
                        some = batch.take(pa.array(at[top]))
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(top), pa.int64()), *some.columns[:-1], pa.array(score[top])], ["q", *names[:-1], "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    found = frame.mapInArrow(best, f"q long, {kinds}, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def _part(count: Column, size: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.ceil(count / size)).cast("int")


def index(vectors: DataFrame, cells: Cells, shard: int) -> tuple[DataFrame, DataFrame]:
    """The written index of usable vectors (vec_id, vector), and (dimension, cell, parts); also the vectors with their cells, written."""
    placed = materialise(cells.placed(vectors, 1), "cells")
    sizes = placed.groupBy("dimension", "cell").agg(F.count(F.lit(1)).alias("n"))  # CELLS rows, and one for each further dimension

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_built(pdf)])

    dealt = placed.join(F.broadcast(sizes), ["dimension", "cell"]).withColumn("part", _part(F.col("n"), shard)).drop("n")
    graphs = materialise(dealt.groupBy(*KEY).applyInPandas(build, INDEX), "hnsw")
    return graphs, placed


def probes(placed: DataFrame, queries: DataFrame, cells: Cells, k: int) -> int:
    """Cells that hold COVERAGE of the true neighbours of TRIALS queries."""
    if len(cells.centroids) == 1:
        return 1
    trials = [(r.q, r.vec_id, r.vector) for r in queries.where(F.size("vector") == cells.centroids.shape[1]).orderBy(F.xxhash64("vec_id"), "q").limit(TRIALS).collect()]
    if not trials:
        return 1
    order = {q: cells.ranked(np.array([v]))[0].tolist() for q, _, v in trials}
    places = sorted(order[r.q].index(r.cell) + 1 for r in exact(placed, trials, k, "cell").select("q", "cell").collect())  # TRIALS * k rows
    return places[math.ceil(COVERAGE * len(places)) - 1] if places else 1


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest other rows found.  Both have vec_id and vector."""
    asked = materialise(queries.select("vec_id", "vector").distinct().select(F.monotonically_increasing_id().alias("q"), "vec_id", "vector"), "queries")
    n = rows.count()
    shard = min(MOST_SHARD, max(LEAST_SHARD, math.ceil(SHARD_GROWTH * math.sqrt(n))))
    cells = fitted(rows, n, shard)
    graphs, placed = index(rows, cells, shard)
    # Every part of a query's cells; a shard that many queries ask is searched by blocks of them.
    routed = cells.placed(asked, probes(placed, asked, cells, k)).join(graphs.select(*KEY).hint("merge"), ["dimension", "cell"])
    routed = materialise(routed.select(*KEY, "q", "vec_id", "vector"), "routed")
    blocks = routed.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    stored = graphs.join(blocks.hint("merge"), KEY).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    everywhere = routed.join(blocks.hint("merge"), KEY).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).drop("blocks")

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in shard.iterrows() if len(block) else ():
            graph, vectors = loaded(row)
            ids, starts = np.asarray(row["ids"]), np.asarray(row["starts"])
            norms = np.linalg.norm(vectors, axis=1)
            wanted = np.stack(block["vector"].to_numpy()).astype(np.float64)
            for at in range(0, len(block), BATCH):
                some = wanted[at : at + BATCH]
                for q, own, v, points in zip(block["q"].to_numpy()[at : at + BATCH], block["vec_id"].to_numpy()[at : at + BATCH], some, graph.search(_unit(some)), strict=True):
                    points = points[points >= 0]
                    scores = vectors[points] @ v / (norms[points] * np.linalg.norm(v))
                    best = []
                    for p, s in zip(points.tolist(), scores.tolist(), strict=True):
                        mine = ids[starts[p] : starts[p + 1]]  # in order; those of the query's own id are left out first
                        low, high = np.searchsorted(mine, own, "left"), np.searchsorted(mine, own, "right")
                        best += [(-s, int(i)) for i in (*mine[: min(low, k)], *mine[high : high + max(0, k - low)])]
                    out += [(int(q), int(own), i, -s) for s, i in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"])

    key = [*KEY, "block"]
    found = stored.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInPandas(search, "q long, query_id long, vec_id long, score double")
    out = materialise(_ranked(found, k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(asked, graphs, placed, routed)
    return out

"""Approximate nearest neighbours by balanced posting lists.

Centroids, one for LIST_SIZE distinct vectors, are fitted on a bounded sample by balanced k-means and kept in
memory with a graph of neighbours that a beam search walks. Every vector goes to the list of its nearest
centroid, a boundary vector also to others almost as near. A query probes the lists whose centroids lie within a
ratio of the nearest one's distance, and further ones until these hold enough vectors. The ratio is measured, not
set: for CALIBRATE queries the true neighbours are found by one pass over all vectors, and the ratio is the one
at which RECALL of these lie in probed lists.

Equal vectors are kept once, with the smallest ids that any answer can hold (there are as many as an answer
is long, and one for the query itself); equal queries are searched once. So neither a vector that very many
rows share nor such a query makes a long list. Vectors are named by 128 bits of hash that are checked to tell
all of them apart, so joins carry names, not vectors. Scores are cosines of the original vectors in double
precision; vectors are scaled by powers of two first, so that no square under- or overflows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, few_rows

K = 5
EVERY = 50
#: Vectors a list aims at; above MAX_LISTS * LIST_SIZE vectors lists grow, and are compared whole, chunk by chunk.
LIST_SIZE = 400
MAX_LISTS = 32_768
#: Rows that fitting may read: so many for each list, and at least so many; picked by hash.
SAMPLE_PER_LIST, SAMPLE = 8, 16_384
#: Vectors and queries compared in one piece.
CHUNK, ASKED = 4000, 8000
NEIGHBOURS = 16
#: Widths of the searches for a vector's own lists and for a query's; where the ratio reaches beyond, all centroids are compared.
BEAM, QUERY_BEAM = 12, 48
#: A vector joins lists up to this ratio of its nearest centroid's distance, and so many at most.
REPLICA_RATIO, REPLICAS = 1.03, 2
#: Queries whose true neighbours are found to set the ratio, and the share of these to be reached.
CALIBRATE, RECALL = 128, 0.95
#: Centroids that one step of fitting tells apart; more are fitted level by level.
BRANCH = 256
#: Vectors that a kernel takes at a time.
ROWS = 1024


@dataclass
class Index:
    """Unit centroids, the graph of their neighbours, and where searches begin."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, unit: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each row of unit vectors, nearest first, and their distances (inf where fewer)."""
        c, n = self.centroids, len(unit)
        beam = min(beam, len(c))
        unit, every = unit.astype(c.dtype), np.arange(n)[:, None]
        distance = lambda rows, to: 2 - 2 * np.matmul(c[to], unit[rows][:, :, None])[:, :, 0]
        ids = np.tile(self.entries[: max(1, min(beam, len(self.entries)))], (n, 1))
        if ids.shape[1] < beam:
            ids = np.concatenate((ids, np.full((n, beam - ids.shape[1]), -1)), axis=1)
        far = np.where(ids < 0, np.inf, distance(np.arange(n), ids))
        seen = np.zeros((n, len(c) + 1), bool)
        seen[every, ids] = True
        done = ids < 0
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], np.inf, far[active])
            at = open_.argmin(axis=1)
            go = np.isfinite(open_[np.arange(len(active)), at])
            active, at = active[go], at[go]
            if not len(active):
                break
            done[active, at] = True
            new = self.graph[ids[active, at]]
            d = distance(active, new)
            d[seen[active[:, None], new]] = np.inf
            seen[active[:, None], new] = True
            new = np.concatenate((ids[active], new), axis=1)
            d = np.concatenate((far[active], d), axis=1)
            closed = np.concatenate((done[active], ~np.isfinite(d[:, beam:])), axis=1)
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            ids[active], far[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (new, d, closed))
        order = far.argsort(axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(far, order, axis=1), 0))

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (unit.astype(self.centroids.dtype) @ self.centroids.T), 0))

    def lists(self, unit: np.ndarray, ratio: float, most: int | None = None, sizes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is the nearest): lists within ratio of the nearest one's distance, and on until `sizes` add up to `least`."""
        step = max(1, min(ROWS, (1 << 24) // len(self.centroids)))  # bounds the marks of what was seen
        parts = [self._lists(unit[at : at + step], ratio, most, sizes, least) for at in range(0, len(unit), step)]
        row = np.concatenate([r + i * step for i, (r, _, _) in enumerate(parts)])
        return row, np.concatenate([to for _, to, _ in parts]), np.concatenate([first for _, _, first in parts])

    def _lists(self, unit, ratio, most, sizes, least):
        def within(ids: np.ndarray, far: np.ndarray) -> np.ndarray:
            take = far <= ratio * far[:, :1] + 1e-6
            if sizes is not None:
                held = np.where(np.isfinite(far), sizes[ids], 0)
                take |= held.cumsum(axis=1) - held < least
            return take & np.isfinite(far)

        ids, far = self.search(unit, BEAM if most is not None else QUERY_BEAM)
        take = within(ids, far)
        if most is not None:
            take[:, most:] = False
        row, column = np.nonzero(take)
        to = ids[row, column]
        if most is None and ids.shape[1] < len(self.centroids):
            beyond = take.sum(axis=1) == np.isfinite(far).sum(axis=1)  # the beam ends within the ratio
            stay = ~beyond[row]
            parts = [(row[stay], column[stay], to[stay])]
            some = np.flatnonzero(beyond)
            if len(some):
                every = self.distances(unit[some])
                ids = every.argsort(axis=1, kind="stable")
                at, column = np.nonzero(within(ids, np.take_along_axis(every, ids, axis=1)))
                parts.append((some[at], column, ids[at, column]))
            row, column, to = map(np.concatenate, zip(*parts, strict=True))
        return row, to, column == 0


def scaled_rows(vectors: np.ndarray) -> np.ndarray:
    """vectors times powers of two that bring each row's largest component to between 1/2 and 1; exact but for denormals."""
    _, e = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    half = -e // 2
    return np.ldexp(np.ldexp(vectors, half), -e - half)  # in two steps, as one factor may itself overflow


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    s = scaled_rows(vectors)
    return s / np.linalg.norm(s, axis=1, keepdims=True)


def _balanced(unit: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k centroids of unit vectors and the one each vector goes to, by k-means with a penalty for full lists."""
    centroids = unit[rng.choice(len(unit), k, replace=False)]
    full, to = np.zeros(k), np.zeros(len(unit), int)
    for _ in range(12):
        for at in range(0, len(unit), 1 << 14):
            to[at : at + (1 << 14)] = (unit[at : at + (1 << 14)] @ centroids.T - 0.1 * full / max(1.0, len(unit) / k)).argmax(axis=1)
        size = np.bincount(to, minlength=k).astype(float)
        full = 0.5 * full + 0.5 * np.maximum(0, size - len(unit) / k)
        order = np.argsort(to, kind="stable")
        held = np.flatnonzero(size)
        sums = np.zeros_like(centroids)
        sums[held] = np.add.reduceat(unit[order], (np.cumsum(size) - size).astype(int)[held], axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids, to


def _centroids(unit: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    if k <= BRANCH:
        return _balanced(unit, k, rng)[0]
    branches = int(np.ceil(np.sqrt(k)))
    _, to = _balanced(unit, branches, rng)
    parts = [unit[to == b] for b in range(branches)]
    return np.concatenate([_centroids(p, max(1, min(len(p), round(k * len(p) / len(unit)))), rng) for p in parts if len(p)])


def fit(sample: np.ndarray, rows: int, list_size: int = LIST_SIZE) -> Index:
    """An index for a table of `rows` distinct vectors from a sample of them."""
    unit = unit_rows(sample.astype(np.float64)).astype(np.float32)
    k = int(max(1, min(MAX_LISTS, -(-rows // list_size), max(1, len(unit) // 4))))
    rng = np.random.default_rng(7)
    centroids = _centroids(unit, k, rng)
    k = len(centroids)
    links = min(NEIGHBOURS, k - 1)
    graph = np.zeros((k, max(1, links)), np.int32)
    step = max(1, (1 << 24) // k)
    for at in range(0, k if links else 0, step):
        near = centroids[at : at + step] @ centroids.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        graph[at : at + step] = np.argpartition(-near, links - 1, axis=1)[:, :links]
    ring = ((np.arange(k)[:, None] + np.array([1, 1 + k // 3])) % k).astype(np.int32)  # keeps the graph in one piece
    return Index(centroids, np.concatenate((graph, ring), axis=1), rng.permutation(k)[: min(k, 8)])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: rows with an id and a vector that has no null or non-finite component and isn't zero."""
    kind = rows.schema[vector_col].dataType.simpleString()
    stored = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast(stored).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.where(F.forall("v", ok)).where(F.exists("v", lambda x: x != 0.0))


def _name(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), "v").alias("a"), F.xxhash64(F.lit(2 * seed + 1), "v").alias("b")]


def _top(score: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n best of a row of scores, ties by order; all as good as the n-th are weighed."""
    n = min(n, len(score))
    best = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return best[np.lexsort((order[best], -score[best]))[:n]]


def _measured_ratio(distinct: DataFrame, queries: DataFrame, index: Index, shipped, k: int, recall: float) -> float:
    """The ratio within which `recall` of the true neighbours of some queries lie, from one pass over all vectors."""
    asked = queries.orderBy("a", "b").limit(CALIBRATE).toArrow()
    if not asked.num_rows:
        return 1.0
    unit, own = unit_rows(_matrix(asked.column("v"))), list(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True))

    def run(batches):
        kept = np.full((len(unit), k), -np.inf)
        vectors = np.zeros((len(unit), k, unit.shape[1]))
        for batch in few_rows(batches, ROWS):
            m = unit_rows(_matrix(batch.column(2)))
            score = unit @ m.T
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for q, (x, y) in enumerate(own):
                score[q, (a == x) & (b == y)] = -np.inf
            joined = np.concatenate((kept, score), axis=1)
            best = np.argpartition(-joined, k - 1, axis=1)[:, :k]
            for q in np.flatnonzero((best >= k).any(axis=1)).tolist():
                vectors[q] = np.where((best[q] >= k)[:, None], m[np.maximum(best[q] - k, 0)], vectors[q][np.minimum(best[q], k - 1)])
            kept = np.take_along_axis(joined, best, axis=1)
        q, at = np.nonzero(np.isfinite(kept))
        if len(q):
            far = shipped.value.distances(unit)
            row, to, _ = shipped.value.lists(vectors[q, at], REPLICA_RATIO, REPLICAS)
            need = np.full(len(q), np.inf)
            np.minimum.at(need, row, far[q[row], to] / np.maximum(far.min(axis=1)[q[row]], 1e-6))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(kept[q, at]), pa.array(need)], names=["q", "score", "need"])

    near = distinct.select("a", "b", "v").mapInArrow(run, "q int, score double, need double")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    need = np.array([r["need"] for r in near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).collect()])  # at most k * CALIBRATE rows
    return max(1.0, float(np.quantile(need, recall, method="higher"))) if len(need) else 1.0


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, probe_ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a row whose id `every` divides.

    A row is no candidate of its own; other rows of the same id are, and each row of an id that repeats is a
    query with its own ranks. With fewer candidates than k all found come. Ties go to the smaller vec_id. Null,
    zero, ragged-length (other than the longest-used one) and non-finite vectors, and null ids, take no part;
    components may be as small or large as doubles go. probe_ratio fixes the ratio, else it is measured for
    `recall`. An empty table gives an empty result; other columns are not read.
    """
    spark, usable = rows.sparkSession, _usable(rows, id_col, vector_col)
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("v") == length["n"])
    seed = 0
    while True:  # until names tell all vectors apart: nearly always at once
        named = usable.select("vec_id", "v", *_name(seed))
        # Of equal vectors the k + 1 smallest ids: row_number() <= k + 1 is applied before the shuffle, too.
        same = Window.partitionBy("a", "b", "v").orderBy("vec_id")
        kept = named.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
        table = durable(kept)
        distinct = table.where("rn = 1").select("a", "b", F.col("vec_id").alias("vid"), "v")
        count = distinct.count()
        if distinct.select("a", "b").distinct().count() == count:
            break
        seed += 1
    size = max(SAMPLE, SAMPLE_PER_LIST * min(MAX_LISTS, -(-count // LIST_SIZE)))
    place = F.pmod("a", F.lit(1 << 40))
    sample = distinct.where(place < int((1 << 40) * min(1.0, size / count))).select("a", "v").toArrow().sort_by("a")
    index = fit(_matrix(sample.column("v")), count) if sample.num_rows else Index(np.eye(1, length["n"], dtype=np.float32), np.zeros((1, 1), np.int32), np.zeros(1, np.int64))
    shipped = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and their graph

    def deal(ratio: float, most: int | None, sizes: np.ndarray | None = None):
        def run(batches):
            for batch in few_rows(batches, ROWS):
                row, to, first = shipped.value.lists(unit_rows(_matrix(batch.column(batch.num_columns - 1))), ratio, most, sizes, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(first), *batch.take(pa.array(row)).columns], names=["list", "first", *batch.schema.names])

        return run

    vector = distinct.schema["v"].dataType.simpleString()
    dealt = "list int, first boolean, a long, b long, vid long, v " + vector
    lists = durable(distinct.mapInArrow(deal(REPLICA_RATIO, REPLICAS), dealt))
    asked = named.where(F.col("vec_id") % every == 0)
    queries = durable(table.where("rn = 1").select("a", "b", "vec_id", "v").join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", F.col("vec_id").alias("vid"), "v"))
    if probe_ratio is None:
        probe_ratio = _measured_ratio(distinct, queries, index, shipped, k, recall)
    sizes, chunks, parts = (np.zeros(len(index.centroids), np.int64) for _ in range(3))
    for held in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("own")).collect():  # at most MAX_LISTS rows
        chunks[held["list"]], sizes[held["list"]] = -(-held["n"] // CHUNK), held["own"]
    probes = durable(queries.mapInArrow(deal(probe_ratio, None, sizes), dealt))
    for held in probes.groupBy("list").count().collect():  # at most MAX_LISTS rows
        parts[held["list"]] = -(-held["count"] // ASKED)
    met = np.flatnonzero(chunks * parts)
    cut = F.broadcast(spark.createDataFrame([(int(i), int(chunks[i]), int(parts[i])) for i in met], "list int, chunks int, parts int"))
    spread = lambda df, own, own_of, other, other_of: df.drop("first").join(cut, "list").withColumn(own, F.pmod(F.col("a"), F.col(own_of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_of) - 1))).drop("chunks", "parts")
    lists, probes = spread(lists, "chunk", "chunks", "part", "parts"), spread(probes, "part", "parts", "chunk", "chunks")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            c, order = scaled_rows(_matrix(left.column("v"))), left.column("vid").to_numpy()
            cn = np.linalg.norm(c, axis=1)
            for at in range(0, right.num_rows, 512):
                q = scaled_rows(_matrix(right.column("v").slice(at, 512)))
                score = (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * cn[None, :])
                for i in range(len(q)):
                    best = _top(score[i], order, k + 1)
                    out.append((np.full(len(best), at + i), best, score[i, best]))
        row, column, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        asked, found = right.select(["a", "b"]).take(pa.array(row)), left.select(["a", "b", "vid"]).take(pa.array(column))
        return pa.table([*asked.columns, *found.columns, pa.array(score)], names=["qa", "qb", "a", "b", "vid", "score"])

    key = ["list", "chunk", "part"]
    hits = lists.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(compare, "qa long, qb long, a long, b long, vid long, score double")
    best = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "vid", "a", "b")
    hits = durable(hits.groupBy("qa", "qb", "a", "b", "vid").agg(F.max("score").alias("score")).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn", "vid"))
    # Distinct vectors back to rows, then each query without its own row.
    found = hits.join(table.select("a", "b", "vec_id"), ["a", "b"]).select("qa", "qb", "vec_id", "score", ((F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).alias("same"))
    top = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k + 1).drop("rn")
    lines = found.groupBy("qa", "qb").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id", "same"))).alias("best"))  # at most k + 1
    # Both sides are dealt anew by the complement, so that a vector that very many queries share can be split.
    other = lambda a, b: [F.bitwise_not(a).alias("ka"), F.bitwise_not(b).alias("kb")]
    out = asked.select(F.col("vec_id").alias("query_id"), *other("a", "b")).join(lines.select(*other("qa", "qb"), "best").hint("merge"), ["ka", "kb"])
    own = F.array_position(F.transform("best", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("best", 1, own - 1), F.slice("best", own + 1, k + 1))).otherwise(F.col("best"))
    out = out.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))

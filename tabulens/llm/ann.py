"""Approximate nearest neighbours by learned partitions (op10).

A bounded sample (SAMPLE rows in hash order of their ids) gives a neighbour graph, which is cut into parts of equal
size with few edges between them. A small network learns to tell a vector's part from the vector. Every row of the
table is then indexed under its most probable part, and a query visits its PROBES most probable parts, PROBES being
the least number that finds RECALL of the sample's own neighbours, and further ones until these hold enough candidates.
Within a part the search is exact.

A part is searched in tiles of at most about TILE candidates by TILE queries, so neither a large part nor a frequent
query direction ends in one task. Equal vectors are one candidate with its k + 1 smallest ids, which is all that an
exact answer can need of them.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; nor do rows with a
null vec_id or with another dimension than most rows have. Ties go to the smaller id. Queries get all candidates that
their parts hold where these are fewer than k. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import cut, table

SAMPLE = 4_000
NEIGHBOURS = 10
#: A table of n rows gets about n / PART_ROWS parts, each of at least PART_SAMPLE rows of the sample.
PART_ROWS, LEAST_PARTS, PART_SAMPLE = 2_500, 4, 16
RECALL = 0.98
TILE = 4_096
HIDDEN = 96


def balanced_parts(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of equal size of the neighbour graph of x: balanced seeds, then moves to where most neighbours are."""
    n = len(x)
    room = -(-n // parts)
    near = np.argsort(-(x @ x.T) + 1e9 * np.eye(n), axis=1, kind="stable")[:, : min(NEIGHBOURS, n - 1)]
    centres = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, int)
    for _ in range(8):
        gain = x @ centres.T
        size = np.zeros(parts, int)
        for i in np.argsort(-gain.max(axis=1), kind="stable"):
            for p in np.argsort(-gain[i], kind="stable"):
                if size[p] < room:
                    label[i], size[p] = p, size[p] + 1
                    break
        centres = np.stack([x[label == p].mean(axis=0) if (label == p).any() else x[rng.integers(n)] for p in range(parts)])
    size = np.bincount(label, minlength=parts)
    for _ in range(10):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[near[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[label[i]] and size[best] < 1.1 * room:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network of one hidden layer that gives the log probability of each part."""

    def __init__(self, x: np.ndarray, rows: int, k: int):
        rng = np.random.default_rng(5)
        self.parts = int(min(max(LEAST_PARTS, -(-rows // PART_ROWS)), max(LEAST_PARTS, SAMPLE // PART_SAMPLE), len(x)))
        self.scale = float(np.sqrt((x * x).sum(axis=1).mean()))
        x = x / self.scale
        label = balanced_parts(x, self.parts, rng)
        d = x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, self.parts)), np.zeros(self.parts)]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step = 0
        for _ in range(30):
            order = rng.permutation(len(x))
            for rows_ in np.array_split(order, max(1, len(x) // 128)):
                step += 1
                a, y = x[rows_], label[rows_]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.w[2].T) * (h > 0)
                for j, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    self.w[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        ranked = self.ranked(x * self.scale)
        place = np.empty_like(ranked)
        np.put_along_axis(place, ranked, np.arange(self.parts)[None, :].repeat(len(x), 0), axis=1)
        near = np.argsort(-(x @ x.T) + 1e9 * np.eye(len(x)), axis=1)[:, : min(k, len(x) - 1)]
        visit = np.take_along_axis(place, ranked[near, 0], axis=1) if near.size else np.zeros(1, int)
        self.probes = int(np.quantile(visit, RECALL, method="higher")) + 1

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The parts of each vector, the most probable first."""
        h = np.maximum(x / self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows, by inner product, that are found for each row that is_query admits."""
    spark = rows.sparkSession
    source = rows.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col("_query").alias("query"))
    source = usable(source)
    sizes = source.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    source = source.where(F.size("v") == sizes[0]["d"])

    # Equal vectors are one candidate; the limit on ranks holds within each task before any shuffle.
    marked = source.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    first = marked.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    vectors = cut(first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "ann-vectors")

    count = vectors.count()
    share = min(1.0, (2.0 * SAMPLE + 100) / count)
    near_top = vectors.where(F.pmod("h1", F.lit(1 << 20)) < share * (1 << 20))
    sample = near_top.orderBy("h1", "h2").limit(SAMPLE).select("v").collect()
    router = Router(np.array([r.v for r in sample]), count, k)
    shared = spark.sparkContext.broadcast(router)  # bounded by the sample

    def index(batches):
        for b in batches:
            if b.num_rows:
                part = shared.value.ranked(matrix(b.column("v")))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("h1"), b.column("ids"), b.column("v")], ["part", "h", "ids", "v"])

    def route(batches):
        for b in batches:
            if b.num_rows:
                ranked = shared.value.ranked(matrix(b.column("v")))
                enough = (np.cumsum(rows_of[ranked], axis=1) <= k).sum(axis=1) + 1
                parts = [r[: max(shared.value.probes, e)] for r, e in zip(ranked.tolist(), enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(parts, pa.list_(pa.int32()))], ["id", "v", "parts"])

    indexed = cut(vectors.mapInArrow(index, "part int, h long, ids array<long>, v array<double>"), "ann-index")
    held = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    rows_of = np.array([held.get(p, 0) for p in range(router.parts)])
    queries = cut(source.where("query").select("id", "v").mapInArrow(route, "id long, v array<double>, parts array<int>"), "ann-queries")
    asked = {r["part"]: r["count"] for r in queries.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}

    def tiles(of: dict) -> Column:
        return F.element_at(F.array(*(F.lit(max(1, -(-of.get(p, 0) // TILE))) for p in range(router.parts))), F.col("part") + 1)

    def dealt(df: DataFrame, mark: str, own: dict, other: dict, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(9), mark), tiles(own)).cast("int").alias(names[0])
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), tiles(other) - 1)).alias(names[1]))

    left = dealt(indexed, "h", held, asked, ("ct", "qt")).select("part", "ct", "qt", F.lit(None).cast("long").alias("query_id"), "ids", "v")
    right = dealt(queries.select("id", "v", F.explode("parts").alias("part")), "id", asked, held, ("qt", "ct"))
    right = right.select("part", "ct", "qt", F.col("id").alias("query_id"), F.lit(None).cast("array<long>").alias("ids"), "v")

    def nearest(t: pa.Table) -> pa.Table:
        is_query_row = np.asarray(t.column("query_id").combine_chunks().is_valid())
        v = matrix(t.column("v"))
        candidates, asked_ = v[~is_query_row], v[is_query_row]
        ids = [x for x in t.column("ids").to_pylist() if x is not None]
        query_ids = [x for x in t.column("query_id").to_pylist() if x is not None]
        out: list[tuple[int, int, float]] = []
        for a in range(0, len(query_ids) if len(ids) else 0, 256):
            block = asked_[a : a + 256]
            rough = block @ candidates.T
            top = min(k + 1, len(ids))
            limit = -np.partition(-rough, top - 1, axis=1)[:, top - 1]
            for i, own in enumerate(query_ids[a : a + 256]):
                best = np.flatnonzero(rough[i] >= limit[i] - 1e-9 * (1 + abs(limit[i])))
                exact = (candidates[best] * block[i]).sum(axis=1)
                found = sorted((-s, x) for s, j in zip(exact.tolist(), best.tolist(), strict=True) for x in ids[j] if x != own)
                out += [(own, x, -s) for s, x in found[:k]]
        q, x, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.unionByName(right).groupBy("part", "ct", "qt").applyInArrow(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

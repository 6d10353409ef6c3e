"""Exact k-means on integer vectors with balls.

A cluster is a ball: its centroid and the distance of its furthest member. Only a centroid that is less
than twice that distance away is a neighbour. Members nearer to their centroid than half way to the
nearest neighbour are the stable core and stay; the others lie in annuli, between the half ways to
one neighbour and the next, and are compared with the neighbours whose half way they are beyond. Balls
are taken within a block of vectors, where they are smaller still; all comparisons are of integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_in_buckets, cut_lineage


def _squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Balls:
    """Centroids (k x width, int64) with the squared distances between them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.between = np.array([_squared(centroids, c) for c in centroids])

    def nearest(self, vectors: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number) and its squared distance; own
        is where each vector was before, if it is known."""
        if own is None:
            own = np.zeros(len(vectors), np.int64)
        best, least = own.astype(np.int64), np.zeros(len(vectors), np.int64)
        for c in np.unique(own):
            members = np.flatnonzero(own == c)
            some = vectors[members]
            first = _squared(some, self.centroids[c])
            order = np.argsort(self.between[c], kind="stable")
            # a neighbour at exactly half way may be as near and have the smaller number
            order = order[(order != c) & (self.between[c][order] <= 4 * int(first.max()))]
            beyond = np.searchsorted(self.between[c][order], 4 * first, "right")
            at, distance = np.full(len(members), c), first.copy()
            for n, j in enumerate(order):
                rows = np.flatnonzero(beyond > n)
                other = _squared(some[rows], self.centroids[j])
                closer = (other < distance[rows]) | (other == distance[rows]) & (j < at[rows])
                at[rows[closer]], distance[rows[closer]] = j, other[closer]
            best[members], least[members] = at, distance
        return best, least


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """block, ids, vectors: up to block_rows vectors side by side."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            vectors = np.concatenate([x.flatten().to_numpy() for x in table.column(1).chunks]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([table.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([vectors.tobytes()], pa.binary())], ["block", "ids", "vectors"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == block_rows:
                    yield out()
                    number, held, count = number + 1, [], 0
        if count:
            yield out()

    return rows.mapInArrow(pack, "block long, ids array<long>, vectors binary")


def cluster(vectors: DataFrame, width: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:", block_rows: int = 2048) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long) of each vector that counts.

    vectors has vec_id and embedding. Vectors of width components, none null or non-finite, count, and
    become floor(scale * component). The first centroids are the k vectors whose ids have the smallest
    sha256 of seed and id in decimal (a null id: of seed alone; equal ids: by the vectors), fewer if
    there are fewer. Each of the rounds moves vectors to the nearest centroid by squared distance (ties:
    the smaller number) and centroids to the floor of the mean of their vectors, in integers; one without
    vectors stays. Then vectors are assigned once more. Repeated rows are vectors of their own. Other
    columns are ignored, an empty table gives no rows. Components must be small enough for a squared
    distance to be a long (131,072 in absolute value at 64 components and a scale of 1024), else it fails.

    Vectors are shuffled once, into blocks in buckets; what a round writes is a cluster number a vector
    and sums per block, summed by Spark; k x width numbers reach the driver."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    x, limit = F.col("embedding").cast("array<double>"), math.isqrt((1 << 61) // width)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == width)
    rows = rows.where(~F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    too_large = F.raise_error(F.lit("a component is too large for exact distances")).cast("long")
    rows = rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) > limit, too_large).otherwise(F.floor(c * scale).cast("long"))).alias("v"))
    # the k first centroids, a bounded number of rows
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["v"] for r in rows.orderBy(key, "v").limit(k).collect()], np.int64).reshape(-1, width)
    k = len(centroids)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut_in_buckets(_blocks(rows, block_rows).repartition(n, "block"), "block")

    def moved(balls: Balls):  # noqa: ANN202
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    block = np.frombuffer(row["vectors"], np.int64).reshape(-1, width)
                    own, _ = balls.nearest(block, np.frombuffer(row["own"], np.uint16) if row["own"] else None)
                    sums = [[c, int((own == c).sum()), block[own == c].sum(0).tolist()] for c in np.unique(own).tolist()]
                    out.append((row["block"], own.astype(np.uint16).tobytes(), [dict(zip(("cluster", "n", "sums"), s, strict=True)) for s in sums]))
                if out:
                    kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "own", "parts"])

        return over

    def settled(balls: Balls):  # noqa: ANN202
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = np.frombuffer(row["vectors"], np.int64).reshape(-1, width)
                    own, distance = balls.nearest(block, np.frombuffer(row["own"], np.uint16) if row["own"] else None)
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

        return over

    state = spark.createDataFrame([], "block long, own binary")
    for _ in range(rounds if k else 0):
        balls = Balls(centroids)
        state = cut_lineage(blocks.join(state.select("block", "own"), "block", "left").select("block", "vectors", "own").mapInArrow(moved(balls), "block long, own binary, parts array<struct<cluster: int, n: long, sums: array<long>>>"))
        parts = state.select(F.explode("parts").alias("p")).select("p.cluster", "p.n", "p.sums")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)])
        after = centroids.copy()
        for r in total.collect():  # k rows at most
            after[r["cluster"]] = [int(s) // r["n"] for s in r[2:]]
        if (after == centroids).all():
            break  # all further rounds would leave everything as it is
        centroids = after
    final = cut_lineage(blocks.join(state.select("block", "own"), "block", "left").select("ids", "vectors", "own").mapInArrow(settled(Balls(centroids)), "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return final.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

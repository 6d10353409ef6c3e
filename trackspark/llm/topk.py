"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates and queries are packed into blocks of bounded size; every query block meets every candidate
block. A candidate block has one list per dimension, sorted by component. For each query the lists
are read in step, from the end its component prefers; candidates seen for the first time get their
full score; reading stops once no unseen candidate can beat the kth best, as the sum of the products
at the present depth shows. Each block pair leaves k rows a query, and the best k of these remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

EXACT = float(1 << 53)


class SortedLists:
    """The candidates of a block with their lists: order[d] has rows by component d, largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(-vectors[by_id], axis=0, kind="stable").T.copy()
        self.floats = self.vectors.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer inner products, exact: in floats while they surely fit, else in Python's integers,
        held within a long."""
        if self.largest * float(np.abs(query.astype(np.float64)).sum()) < EXACT:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        exact = self.vectors[rows].astype(object) @ query.astype(object)
        return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)

    def top(self, query: np.ndarray, k: int, own: int, first: int = 64) -> list[tuple[int, int]]:
        """The k best (score, id) of ids other than own; ties to the smaller id."""
        n, used = len(self.ids), np.flatnonzero(query)
        seen, best = np.zeros(n, bool), []
        up = query[used] > 0
        lists = np.where(up[:, None], self.order[used], self.order[used, ::-1]) if len(used) else np.zeros((0, n), int)
        weight, depth = np.abs(query[used].astype(np.float64)), 0
        while depth < n:
            more = min(n, max(first, 4 * depth)) if len(used) else n
            new = np.zeros(n, bool)
            if len(used):
                new[lists[:, depth:more].ravel()] = True
            else:
                new[:] = True
            rows = np.flatnonzero(new & ~seen)
            seen |= new
            depth = more
            rows = rows[self.ids[rows] != own]
            if len(rows):
                score = self.scores(rows, query)
                pick = rows if len(rows) <= k else rows[score >= np.partition(score, -k)[-k]]
                score = score[np.searchsorted(rows, pick)]
                best = sorted([*best, *zip((-score).tolist(), self.ids[pick].tolist(), strict=True)])[:k]
            if depth < n and len(best) == k:
                at = self.floats[lists[:, depth - 1], used]
                bound = float((np.where(up, at, -at) * weight).sum())
                # an unseen candidate scores at most the bound: strictly less than the kth can't win,
                # and floats may be off by a rounding
                if bound + 1e-9 * abs(bound) + 1 < -best[-1][0]:
                    break
        return [(-s, i) for s, i in best]


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """block, ids and vectors (int64, packed) of each block; rows are dealt by a hash of the id."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        # in an order that a repeated task finds again, as a row's place in its block tells it from its equals
        frame = frame.assign(v=[tuple(v) for v in frame["v"]]).sort_values(["vec_id", "v"], kind="stable")
        out, first = [], int(frame["block"].iloc[0]) << 32
        for w in sorted({len(v) for v in frame["v"]}):  # vectors of unequal lengths never meet
            some = frame[frame["v"].map(len) == w]
            out.append((int(some["block"].iloc[0]), w, first, some["vec_id"].to_numpy(np.int64).tobytes(), np.array(some["v"].tolist(), np.int64).tobytes()))
            first += len(some)
        return pd.DataFrame(out, columns=["block", "width", "first", "ids", "vectors"])

    packed = dealt.groupBy("block").applyInPandas(pack, "block int, width int, first long, ids binary, vectors binary")
    return packed.select(F.col("block").alias(name), "width", *[F.col(c).alias(f"{name}_{c}") for c in ("first", "ids", "vectors")])


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block_rows: int = 16384, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows.

    vectors has vec_id and embedding; components become floor(scale * x), in double. Queries are the
    rows whose vec_id is divisible by every; candidates all rows but those with the query's own id.
    Fewer candidates than k give fewer rows; ties go to the smaller vec_id. Rows with a null id, a
    null, empty or unequally long vector, or null or non-finite components take no part (vectors of
    another length than the query's aren't its candidates). Components are held within +-2^62 and
    scores within a long. Repeated rows are repeated candidates, and rows that share a query id are
    queries of their own, each with its k rows. An empty table gives no rows.

    A block pair needs a candidate block's vectors and lists and a query block in memory: with 16384
    rows of 64 components about 30 MB. Results of a query are k per block.
    """
    bounded_batches(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    limit = float(1 << 62)
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-limit)), F.lit(limit))).cast("long")).alias("v"))
    queries = rows.where(F.col("vec_id") % every == 0)
    n, q = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    parts = max(1, -(-n // block_rows), min(64, n // 256))
    candidates = _packed(rows, parts, "c")
    asked = _packed(queries, max(1, -(-q // query_rows)), "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = None, None  # the query blocks of a candidate block come one after the other
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["q_ids"], np.int64)
                asking = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["width"])
                if held != (row["c"], row["width"]):
                    held = row["c"], row["width"]
                    lists = SortedLists(np.frombuffer(row["c_ids"], np.int64), np.frombuffer(row["c_vectors"], np.int64).reshape(-1, row["width"]))
                found = [(row["q_first"] + n, int(i), s, v) for n, (i, vec) in enumerate(zip(at, asking, strict=True)) for s, v in lists.top(vec, k, int(i))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query", "query_id", "score", "vec_id"])

    pairs = candidates.join(asked, ["c", "width"]).select("c", "width", "c_ids", "c_vectors", "q_first", "q_ids", "q_vectors")
    found = pairs.mapInArrow(search, "query long, query_id long, score long, vec_id long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Whitening of vectors by an exact scatter matrix in residues.

Components become integers, and the vectors to fit on are centred in integers too, as n * x - sum. Each
partition multiplies their residues modulo several primes as matrices, in doubles that stay exact;
the sums of these products over all partitions are put together by the Chinese remainder theorem to the
exact scatter matrix, whose eigenvectors are then found in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage

#: Residues are below it: a product of 2^13 rows stays below 2^53.
PRIMES_BELOW, ROWS = 1 << 20, 1 << 13


def primes(least_product: int) -> list[int]:
    """The largest primes below PRIMES_BELOW, as many as their product needs to exceed least_product."""
    found, p = [], PRIMES_BELOW - 1
    while prod(found) <= least_product:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
        p -= 1
    return found


def restored(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest to zero with these residues."""
    whole = prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of int64 numbers, from those of their halves."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


class Fit:
    """What whitening needs of the vectors fitted on: their number, the exact sums, components."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], components: int):
        self.n, self.sums = n, sums
        covariance = np.array([[s / n**3 for s in row] for row in scatter])
        values, vectors = np.linalg.eigh(covariance)
        values, vectors, trace = values[::-1], vectors[:, ::-1], sum(scatter[i][i] for i in range(len(sums))) / n**3
        # what rounding leaves of an eigenvalue of zero is no component
        keep = np.flatnonzero(values[:components] > trace * len(sums) * 2.0**-50)
        self.values, self.vectors = values[keep], vectors[:, keep]
        self.vectors *= np.where(self.vectors[np.abs(self.vectors).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
        self.explained = (self.values / trace).tolist() if len(keep) else []

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as int64 where that surely holds it, else as Python's integers."""
        most = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviation(self, centred: np.ndarray) -> list[int]:
        """Sums of squares over dimensions, exact; fails where they are no long."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < 1 << 63:
            return np.einsum("ij,ij->i", centred, centred).tolist()
        return [sum(int(v) ** 2 for v in row) for row in centred.tolist()]


def _sums(fit: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """n, and sum, smallest and largest of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                sums = [str(s) for s in _exact_sums(x)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums), pa.array(x.min(0)), pa.array(x.max(0)), pa.array([len(x)] * len(sums), pa.int64())], ["at", "s", "low", "high", "n"])

    parts = fit.mapInArrow(part, "at int, s string, low long, high long, n long")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows], [r["low"] for r in rows], [r["high"] for r in rows]


def scatter(fit: DataFrame, n: int, sums: list[int], low: list[int], high: list[int]) -> list[list[int]]:
    """Sum of y y' over y = n * x - sums of all rows x of fit, exact."""
    width = len(sums)
    most = max(max(abs(n * v - s) for v in (a, b)) for a, b, s in zip(low, high, sums, strict=True))
    moduli = primes(2 * n * most * most)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((width, width), np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch.column(0))
            for a in range(0, len(x), ROWS):
                for t, p in zip(total, moduli, strict=True):
                    y = ((x[a : a + ROWS] % p * (n % p) - np.array([s % p for s in sums])) % p).astype(np.float64)
                    t += (y.T @ y).astype(np.int64) % p
        for k, (t, p) in enumerate(zip(total, moduli, strict=True)):
            flat = pa.array((t % p).ravel())
            yield pa.RecordBatch.from_arrays([pa.array([k] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.ListArray.from_arrays(np.arange(width + 1, dtype=np.int32) * width, flat)], ["prime", "line", "residues"])

    parts = fit.mapInArrow(part, "prime int, line int, residues array<long>")
    lines = parts.groupBy("prime", "line").agg(F.array(*[F.sum(F.col("residues")[j]) for j in range(width)]).alias("residues")).collect()
    at = {(r["prime"], r["line"]): r["residues"] for r in lines}  # width rows of width numbers for each prime
    return [[restored([at[k, i][j] % p for k, p in enumerate(moduli)], moduli) for j in range(width)] for i in range(width)]


def _finite(x: Column) -> Column:
    return ~F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))


def whiten(vectors: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and
    principal component.

    vectors has vec_id and embedding. Rows with a null or empty vector, or null or non-finite components,
    go; the others become x = floor(scale * component). The fit is on each distinct x once: n vectors
    with sums S. deviation is the sum of (n * x - S)^2 over dimensions; whitened is x - S / n on the
    component over the root of its eigenvalue; explained is the eigenvalue's share of all; identity_error
    the largest absolute entry of whitened's covariance over the fit less the identity. Components are
    numbered from 1 by falling eigenvalue; those without variance are left out, so a table with
    one distinct vector gives no rows. Repeated rows and null ids stay; other columns are ignored; an empty
    table gives no rows. It fails on vectors of unequal lengths, on components that are no
    long, and on a deviation that is no long.

    Equal vectors meet once, by a distinct with partial aggregation; width x width numbers per prime
    reach the driver."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") > 0) & _finite(F.col("x")))
    too_large = F.raise_error(F.lit("a component is no long")).cast("long")
    rows = rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) >= float(1 << 62), too_large).otherwise(F.floor(c * scale).cast("long"))).alias("x"))
    fitted = cut_lineage(rows.select("x").distinct())
    shortest, longest = fitted.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != longest:
        raise ValueError(f"vectors have {shortest} to {longest} components")
    n, sums, low, high = _sums(fitted)
    if not n:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = Fit(n, sums, scatter(fitted, n, sums, low, high), components)
    count = len(fit.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and count:
                centred = fit.centred(_matrix(batch.column(1)))
                ids, deviation = np.repeat(np.arange(batch.num_rows), count), fit.deviation(centred)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()), pa.array(deviation, pa.int64()).take(pa.array(ids)), pa.array(fit.whitened(centred).ravel())], ["vec_id", "component", "deviation", "whitened"])

    def only_whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = fit.whitened(fit.centred(_matrix(batch.column(0)))) if batch.num_rows else np.zeros((0, count))
            yield pa.RecordBatch.from_arrays([pa.array(white[:, c]) for c in range(count)], [f"w{c}" for c in range(count)])

    error = 0.0
    if count:
        white = fitted.mapInArrow(only_whitened, ", ".join(f"w{c} double" for c in range(count)))
        # covar_pop centres before it multiplies
        pairs = [(a, b) for a in range(count) for b in range(a, count)]
        found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
        error = max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))
    out = rows.mapInArrow(project, "vec_id long, component int, deviation long, whitened double")
    shares = F.array(*map(F.lit, fit.explained)) if count else F.array(F.lit(0.0))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("component") - 1].alias("explained"), F.lit(float(error)).alias("identity_error"))

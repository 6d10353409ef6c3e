"""Functions for users of SQL: the pressure identities, and smoothing as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: SQL functions by name: parameters and the expression, so that the optimiser sees through them.
IDENTITIES = {
    "bp_map": ("sbp DOUBLE, dbp DOUBLE", "(sbp + 2 * dbp) / 3"),
    "bp_pp": ("sbp DOUBLE, dbp DOUBLE", "sbp - dbp"),
    "bp_sbp": ("mean DOUBLE, pulse DOUBLE", "mean - pulse / 3 + pulse"),
    "bp_dbp": ("mean DOUBLE, pulse DOUBLE", "mean - pulse / 3"),
    "bp_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END"),
}


class Ewma:
    """ewma(TABLE t PARTITION BY ... ORDER BY ..., column, alpha): the rows of t with a column smoothed, the
    exponential smoothing of the named column within each partition. Missing values are skipped without a
    reset and stay missing. One number is kept, whatever the length of a partition."""

    def __init__(self) -> None:
        self.state: float | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, alpha: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("ewma takes a table, the name of a column and alpha")
        if column.value not in rows.dataType.names:
            raise ValueError(f"ewma: no column {column.value}")
        if alpha.value is None or not 0 < float(alpha.value) <= 1:
            raise ValueError("ewma: alpha must be over 0 and at most 1")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("smoothed", DoubleType())]))

    def eval(self, rows: Row, column: str, alpha: float) -> Iterator[tuple]:
        x = rows[column]
        known = x is not None and x == x
        if known:
            self.state = float(x) if self.state is None else float(alpha) * float(x) + (1 - float(alpha)) * self.state
        yield (*rows, self.state if known else None)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, as temporary ones: bp_map, bp_pp, bp_sbp, bp_dbp, bp_clamp and
    ewma."""
    for name, (parameters, body) in IDENTITIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("ewma", udtf(Ewma))

"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import settle, ship_package

ROW = "_row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{folder}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """A written copy with a row number of its own, so that repeated ids stay apart."""
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()))


def matches(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of columns of two aliased frames."""
    tests = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out

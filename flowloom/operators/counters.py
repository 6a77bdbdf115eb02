"""Running per-address counters and byte totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.prefix import running_sums

ORDER = ["stime", "row_id"]


def running_count(rows: DataFrame, keys: list[str], out: str,
                  source: DataFrame | None = None, order: list[str] = ORDER) -> DataFrame:
    """Number of rows of the key so far, this one included."""
    return running_sums(rows, keys, order, {out: F.lit(1).cast("long")}, source)


def running_bytes(rows: DataFrame, key: str, value: Column, out: str,
                  source: DataFrame | None = None, order: list[str] = ORDER) -> DataFrame:
    return running_sums(rows, [key], order, {out: value}, source)


def file_order(df: DataFrame, file: str = "source_file", time: str = "stime",
               row_id: str = "row_id") -> DataFrame:
    """Files by the time of their first row; a file without one comes last.

    One row per file reaches the final sort.
    """
    from pyspark.sql import Window

    first = df.groupBy(file).agg(F.min_by(time, row_id).alias("first_time"))
    seq = Window.orderBy(F.col("first_time").asc_nulls_last(), file)
    return first.withColumn("file_no", F.row_number().over(seq))

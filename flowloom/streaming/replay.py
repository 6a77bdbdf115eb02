"""Replay a table as a file stream, part by part, and read back what the query wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from flowloom.session import shared_path


def closing(df: DataFrame, time: str, after_ms: int, **values) -> DataFrame:
    """One row ``after_ms`` later than all of ``df``: it moves the watermark past everything before it.

    The row itself stays in a window that never closes.  ``values`` replace columns of the copied row.
    """
    end = df.agg(F.max(time)).first()[0]
    cols = {**values, time: None if end is None else end + after_ms}
    return df.limit(1).withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in cols.items()})


def feed(spark: SparkSession, parts: list[DataFrame], start: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Append each part to a folder and run the query over what is new; returns the folder of all files.

    Every run takes up the checkpointed state of the one before, as after a restart.
    """
    root = shared_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        run = (start(stream, root).option("checkpointLocation", f"{root}/state")
               .trigger(availableNow=True).start())
        run.awaitTermination()
    return root


def replay(spark: SparkSession, parts: list[DataFrame],
           query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a streaming query appends over all parts."""
    root = feed(spark, parts, lambda stream, root: query(stream).writeStream.format("parquet")
                .outputMode("append").option("path", f"{root}/out"))
    return spark.read.parquet(f"{root}/out")


def replay_batches(spark: SparkSession, parts: list[DataFrame],
                   query: Callable[[DataFrame, str], DataStreamWriter]) -> DataFrame:
    """The rows that a query of :func:`flows.by_batches` writes over all parts."""
    root = feed(spark, parts, lambda stream, root: query(stream, f"{root}/keyed"))
    return spark.read.parquet(f"{root}/keyed/out").drop("batch_id")

"""Session settings the operators rely on, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only; cluster sizing (partitions, memory) stays with the caller.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A table hashed on the time slice may then be joined on (slice, key) without moving it again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


MAX_BROADCAST = 64 << 20  # bytes of one broadcast model part


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    # tasks import this package too, also when the program was started in another folder
    environment, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in places:
        environment["PYTHONPATH"] = os.pathsep.join([*places, home])
    return spark


def default_slices(spark: SparkSession) -> int:
    """Number of ordered slices: a few per shuffle partition, so hashing them spreads evenly."""
    return max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; fall back to a private one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="flowloom-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Later jobs scan columns instead of running the plan again, and lost executors cost nothing.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(columns: list[str]) -> list[str]:
    """Column names that may contain dots, as select expressions."""
    return [f"`{c}`" for c in columns]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote and nobody reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

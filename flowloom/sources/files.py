"""Stage files: read one file or a folder, label from the path, write, skip what is done."""

from __future__ import annotations

import io
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.functions.normalize import binary_category, coded
from flowloom.session import materialize


def _reader(spark: SparkSession, schema: T.StructType | None, fmt: str):
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.schema(schema) if schema is not None else reader


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv") -> DataFrame:
    """One stage file (or partitioned folder); the schema is declared, never inferred."""
    return _reader(spark, schema, fmt).load(path)


def read_folder(spark: SparkSession, folder: str, suffix: str,
                schema: T.StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Every file below ``folder`` whose name ends in ``suffix``, with its name kept."""
    df = (_reader(spark, schema, fmt).option("pathGlobFilter", f"*{suffix}")
          .option("recursiveFileLookup", True).load(folder))
    return df.withColumn("source_file", F.substring_index("_metadata.file_name", suffix, 1))


def leaf_folder() -> Column:
    """Name of the folder a row's file lies in; ``key=name`` folders give the name."""
    return F.substring_index(F.element_at(F.split("_metadata.file_path", "/"), -2), "=", -1)


def label_from_path(df: DataFrame, mapping: dict[str, str], out: str = "label") -> DataFrame:
    """Class label from the leaf folder; rows of folders without a mapping are skipped."""
    return df.withColumn(out, coded(leaf_folder(), mapping)).where(F.col(out).isNotNull())


def write_stage(df: DataFrame, path: str, by: str = "source_file", fmt: str = "parquet",
                mode: str = "error", writers: int = 8) -> None:
    """One output folder per input file.

    Rows are dealt over (file, salt) first: a file has up to ``writers`` writers, however large it is, and
    a task writes few files.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(writers))
    df = df.repartition(F.col(f"`{by}`"), salt)
    writer = df.write.mode(mode).partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def pending(df: DataFrame, done: DataFrame, by: str = "source_file") -> DataFrame:
    """Rows of input files that have no output yet."""
    return df.join(done.select(by).distinct(), by, "left_anti")


_EMPTY_BYTES = 8 << 20  # a file without rows that is larger than this is damaged


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def read_checked(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of the whole files of a Parquet folder, and a report on every file.

    A reader that skips damaged files keeps what it decoded before the damage.  Here the rows are written
    once with their file, counted, and held against the count in the file's footer, which a scan of no
    columns gives without decoding anything.  Files with fewer rows than that are left out whole.

    The report has file_path, n_expected, n_read and status: ``read``, ``half-read`` (damaged inside),
    ``unreadable`` (no footer) or ``empty`` (sound, without rows).
    """
    def reader() -> DataFrame:
        found = (spark.read.schema(schema).option("recursiveFileLookup", True)
                 .option("ignoreCorruptFiles", True).parquet(folder))
        return found.withColumn("file_path", _plain(F.col("_metadata.file_path")))

    rows = materialize(reader(), "checked")
    read = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_read"))
    expected = reader().groupBy("file_path").agg(F.count(F.lit(1)).alias("n_expected"))
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = binary.load(folder).select(_plain(F.col("path")).alias("file_path"))
    zero = F.lit(0).cast("bigint")
    counted = (files.join(expected, "file_path", "left").join(read, "file_path", "left")
               .withColumns({c: F.coalesce(c, zero) for c in ("n_expected", "n_read")}))
    small = binary.load(folder).where(F.col("length") <= _EMPTY_BYTES).select(
        _plain(F.col("path")).alias("file_path"), _sound("content").alias("_sound"))
    none = counted.where("n_expected = 0").join(small, "file_path", "left")
    some = counted.where("n_expected > 0").withColumn("_sound", F.lit(True))
    status = (F.when(~F.coalesce("_sound", F.lit(False)), "unreadable").when(F.col("n_expected") == 0, "empty")
              .when(F.col("n_read") < F.col("n_expected"), "half-read").otherwise("read"))
    report = materialize(some.unionByName(none).withColumn("status", status).drop("_sound"), "file-report")
    broken = report.where("status = 'half-read'").select("file_path")
    return rows.join(broken, "file_path", "left_anti"), report


def _sound(content: str) -> Column:
    """Whether bytes are a Parquet file with a footer."""
    def ok(data: bytes) -> bool:
        try:
            return pq.ParquetFile(io.BytesIO(data)).metadata.num_rows >= 0
        except (pa.ArrowException, OSError):
            return False

    @F.pandas_udf("boolean")
    def sound(column: pd.Series) -> pd.Series:
        return column.map(ok)

    return sound(content)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free digest of a table: sums of two 60-bit parts of each row's SHA-256.

    A cell is written with its length before it, a null as ``-``, so no two rows share a text.
    """
    cells = [F.col(f"`{c}`").cast("string") for c in columns or df.columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])
    digest = F.sha2(text.cast("binary"), 256)
    parts = {f"digest_{n}": F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
             for n, at in (("a", 1), ("b", 16))}
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(n) for n, p in parts.items()])


@dataclass(frozen=True)
class DatasetConfig:
    """Where a modelling table lies and how its label becomes the binary target."""

    tag: str
    path: str
    label_col: str
    label_map: str | None = None
    drop_cols: tuple[str, ...] = ()
    fmt: str = "csv"
    schema: T.StructType | None = None


# fixed values: the three modelling tables and the columns each must drop
DATASETS = {
    "OG10": DatasetConfig("OG10", "OG10.csv", "category", None, ("label", "type")),
    "Gen10": DatasetConfig("Gen10", "Gen10.csv", "category", None,
                           ("proto-number", "stime")),
    "GenS10": DatasetConfig("GenS10", "GenS10.csv", "label", "binary_normal",
                            ("ltime",)),
}


def normalize_frame(df: DataFrame, cfg: DatasetConfig) -> DataFrame:
    if cfg.label_map == "binary_normal":
        df = df.withColumn(S.TARGET, binary_category(F.col(f"`{cfg.label_col}`")))
        if cfg.label_col != S.TARGET:
            df = df.drop(cfg.label_col)
    elif cfg.label_map is None:
        df = df.withColumnRenamed(cfg.label_col, S.TARGET)
    else:
        raise ValueError(f"unknown label map {cfg.label_map!r}")
    return df.drop(*[c for c in cfg.drop_cols if c != S.TARGET])


def drop_leaks(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*S.LEAK_COLUMNS, *extra)


def load_normalized(spark: SparkSession, cfg: DatasetConfig) -> DataFrame:
    reader = _reader(spark, cfg.schema, cfg.fmt)
    if cfg.schema is None and cfg.fmt == "csv":
        reader = reader.option("inferSchema", True)
    return normalize_frame(reader.load(cfg.path), cfg)

"""Data contracts: vocabularies, column alignment, rows and columns that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what the raw vocabulary columns are expected to hold
RAW_VOCAB = {"connection_state": ["S0", "SF", "REJ", "OTH"],
             "requested_service": ["-", "dns", "http"], "protocol": ["6", "17"]}


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def required(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with every field present.

    Written as single null checks: the optimizer drops those on columns that cannot be null and
    pushes the rest into the scan, which one combined check would prevent.
    """
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in fields]))


def align(df: DataFrame, reference: list[str]) -> DataFrame:
    """Columns and order of ``reference``; a column the table lacks is filled with 0."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c)
                       for c in reference])


def split_bad_rows(df: DataFrame, computed: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows whose computed (``try_``) values all exist, and the rest unchanged."""
    out = df.withColumns(computed)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in computed])
    return out.where(ok), out.where(~ok).drop(*computed)


def vocabulary_violations(df: DataFrame, vocab: dict[str, list[str]],
                          columns: list[str]) -> DataFrame:
    """Rows per field that hold a value outside its vocabulary; one pass."""
    require_columns(df, columns)
    counts = df.agg(*[F.count(F.when(~F.col(c).isin(v), 1)).alias(c) for c, v in vocab.items()])
    return counts.unpivot([], list(vocab), "field", "violations")


def vocabulary_drift(df: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """Each unexpected value with its row count; one pass over all fields."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"),
                      F.col(c).cast("string").isin(v).alias("known")) for c, v in vocab.items()]
    return (df.select(F.inline(F.array(*cells)))
            .where(~F.col("known") & (F.col("value") != ""))
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))

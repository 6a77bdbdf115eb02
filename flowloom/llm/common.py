"""Column helpers and joins that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.session import materialize

#: A word is a run of characters other than blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"

#: Most rows of a table that may be broadcast after its rows were counted.
BROADCAST_ROWS = 20_000


def c(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def uniform(key: Column) -> Column:
    """A repeatable number inside (0, 1) from a key: 52 bits of its md5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join facts that have one row per key (null is a key) to rows whose keys may be hot.

    Few facts, by count, are broadcast.  Otherwise both sides are dealt by the key; the partition of a
    hot key is then split at run time, as the facts of a key are one row.
    """
    facts = facts.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c(x) for x in facts.columns if x not in keys])
    same = [c(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    if len(facts.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS:
        facts = F.broadcast(facts)
    return rows.join(facts, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add 0-based positions in a total order without a one-task sort.

    Rows are dealt by range and counted per partition; only those counts (one row per partition) are
    summed in one task.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftright("_m", 33)), "order")
    sizes = placed.groupBy("_p").count().collect()  # one number per partition
    start, offsets = 0, []
    for p, n in sorted((r["_p"], r["count"]) for r in sizes):
        offsets.append((p, start))
        start += n
    base = df.sparkSession.createDataFrame(offsets, "_p bigint, _o bigint")
    at = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(base), "_p").withColumn(name, at).drop("_m", "_p", "_o")

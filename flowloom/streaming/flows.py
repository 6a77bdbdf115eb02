"""Streaming twins of the batch operators.

Damped statistics and counters run the batch operators on every micro-batch: its order is cut into
slices, so a key that fills the batch spreads over many tasks, and no row passes Python.  What came
before the batch is a table of a few numbers per key, joined to the batch's rows; the next version of
that table is written beside the output under the number of the batch, so a batch that is run again
finds the state it had and overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from flowloom.operators.contracts import RAW_VOCAB
from flowloom.operators.damped import Stat, damped
from flowloom.operators.flows import canonical_key, flow_totals, orient
from flowloom.operators.prefix import running_sums, spread, time_slices
from flowloom.session import materialize, remove_path

_AT = ["stime", "row_id"]


def by_batches(rows: DataFrame, root: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, list[str]]],
               state: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataStreamWriter:
    """Run ``step`` on every micro-batch with the state before it, write its rows, then the next state.

    ``step`` gives the rows and the columns of the output; ``state`` makes the next state from the written
    rows and the old state.  Output lies in ``root/out``; the states of the last two batches are kept.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{root}/states/{number - 1}") if number else None
        made, columns = step(materialize(batch, "micro-batch"), old)
        made = materialize(made, "micro-rows")
        made.select(*columns).write.mode("overwrite").parquet(f"{root}/out/batch_id={number}")
        state(made, old).write.mode("overwrite").parquet(f"{root}/states/{number}")
        if number > 1:
            remove_path(spark, f"{root}/states/{number - 2}")

    return rows.writeStream.foreachBatch(run)


def damped_stream(flows: DataFrame, keys: list[str], value: Column, lam: float, root: str,
                  expire_ms: int | None = None) -> DataStreamWriter:
    """Damped weight and mean per key, one output row per input row.

    Rows of a micro-batch are taken in the order of time.  A batch that begins before the key's last time
    does not decay the state but moves its time back.  A key without rows for ``expire_ms`` before the
    newest one is forgotten; by default that is when its sums have faded to exp(-40) of themselves.
    """
    expire_ms = int(40_000 / lam) if expire_ms is None else expire_ms
    narrow = flows.select(*keys, *_AT, value.cast("double").alias("x"))

    def step(batch: DataFrame, old: DataFrame | None):
        stats = [Stat("weight", lam, "weight"), Stat("mean", lam, "mean")]
        source = time_slices(batch)
        rows = damped(spread(source), keys, F.col("x"), stats, source=source)
        if old is not None:
            first = batch.groupBy(*keys).agg(F.min("stime").alias("_t0"))
            rows = rows.join(first.join(old, keys), keys, "left")
            since = F.col("stime") - F.col("_t0") + F.greatest(F.col("_t0") - F.col("last_t"), F.lit(0))
            fade = F.coalesce(F.exp(since * (-lam / 1000.0)), F.lit(0.0))
            count, total = (F.coalesce(F.col(c), F.lit(0.0)) * fade for c in ("count", "lin_sum"))
            rows = rows.withColumn("_w", F.col("weight") + count).withColumn(
                "mean", (F.col("mean") * F.col("weight") + total) / F.col("_w")).withColumn("weight", F.col("_w"))
        return rows.select(*keys, *_AT, "weight", "mean"), ["row_id", "weight", "mean"]

    def state(made: DataFrame, old: DataFrame | None) -> DataFrame:
        last = F.max_by(F.struct("stime", "weight", "mean"), F.struct(*_AT)).alias("_e")
        new = made.groupBy(*keys).agg(last).select(*keys, F.col("_e.stime").alias("last_t"), F.col("_e.weight").alias(
            "count"), (F.col("_e.mean") * F.col("_e.weight")).alias("lin_sum"))
        seen = [new.agg(F.max("last_t")).first()[0], old.agg(F.max("last_t")).first()[0] if old is not None else None]
        newest = max((t for t in seen if t is not None), default=0)
        return _kept(new, old, keys).where(F.col("last_t") >= newest - expire_ms)

    return by_batches(narrow, root, step, state)


def _kept(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """The new state of the keys seen, the old one of all others."""
    return new if old is None else new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def counters_stream(flows: DataFrame, keys: list[str], value: Column, root: str) -> DataStreamWriter:
    """Running row count and running total per key; the state is two numbers per key."""
    narrow = flows.select(*keys, *_AT, value.cast("long").alias("x"))

    def step(batch: DataFrame, old: DataFrame | None):
        source = time_slices(batch)
        sums = {"n": F.lit(1).cast("long"), "total": F.col("x")}
        rows = running_sums(spread(source), keys, _AT, sums, source)
        if old is not None:
            rows = rows.join(old.withColumnsRenamed({"n": "_n", "total": "_total"}), keys, "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums})
        return rows.select(*keys, *_AT, "n", "total"), ["row_id", "n", "total"]

    def state(made: DataFrame, old: DataFrame | None) -> DataFrame:
        last = F.max_by(F.struct("n", "total"), F.struct(*_AT)).alias("_e")
        return _kept(made.groupBy(*keys).agg(last).select(*keys, "_e.n", "_e.total"), old, keys)

    return by_batches(narrow, root, step, state)


def flow_assembly_stream(packets: DataFrame, gap_ms: int = 120000,
                         delay: str = "0 seconds") -> DataFrame:
    """Bidirectional flows by session windows; a flow is emitted once the watermark passes it."""
    keyed = canonical_key(packets).withColumn("at", F.timestamp_millis("ts"))
    window = F.session_window("at", f"{gap_ms} milliseconds")
    grouped = keyed.withWatermark("at", delay).groupBy(
        "a_ip", "a_port", "b_ip", "b_port", "protocol", window)
    return orient(grouped.agg(*flow_totals()))


def score_stream(flows: DataFrame, model) -> DataFrame:
    """A fitted detector over a stream: no state, no shuffle."""
    return model.predict(flows)


def vocab_drift_stream(raw: DataFrame, vocab: dict[str, list[str]] = RAW_VOCAB,
                       window: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """Windowed count of values outside the vocabularies."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"),
                      F.col(c).cast("string").isin(v).alias("known")) for c, v in vocab.items()]
    long = (raw.select(F.timestamp_millis("stime").alias("at"), F.inline(F.array(*cells)))
            .withWatermark("at", delay).where(~F.col("known") & (F.col("value") != "")))
    return (long.groupBy(F.window("at", window), "field", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis("window.start").alias("start_ms"), "field", "value", "n"))

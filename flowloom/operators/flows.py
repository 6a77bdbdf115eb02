"""Packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.prefix import SLICE, spread, time_slices

KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


def canonical_key(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation share one key: the smaller end first."""
    forward = F.struct("src_ip", "src_port") <= F.struct("dst_ip", "dst_port")

    def end(yes: str, no: str):
        return F.when(forward, F.col(yes)).otherwise(F.col(no))

    return packets.withColumns({
        "a_ip": end("src_ip", "dst_ip"), "a_port": end("src_port", "dst_port"),
        "b_ip": end("dst_ip", "src_ip"), "b_port": end("dst_port", "src_port"),
        "forward": forward})


def number_sessions(packets: DataFrame, keys: list[str], gap_ms: int, time: str = "ts",
                    row_id: str = "row_id", slices: int | None = None) -> DataFrame:
    """Add ``session``: a new one starts after ``gap_ms`` or more without a packet of the key."""
    rows = spread(time_slices(packets, time, row_id, slices))
    seq = Window.partitionBy(SLICE, *keys).orderBy(time, row_id)
    inside = F.when(F.col(time) - F.lag(time).over(seq) >= gap_ms, 1).otherwise(0)
    rows = rows.withColumn("_break", inside)
    cells = rows.groupBy(SLICE, *keys).agg(F.sum("_break").alias("_n"), F.min(time).alias("_t0"),
                                           F.max(time).alias("_t1"))
    over = Window.partitionBy(*keys).orderBy(SLICE)
    last = F.lag("_t1").over(over)
    cells = cells.withColumn("_open", F.when(last.isNull() | (F.col("_t0") - last >= gap_ms), 1)
                             .otherwise(0))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_start", F.coalesce(F.sum(F.col("_n") + F.col("_open"))
                                                  .over(earlier), F.lit(0)) + F.col("_open"))
    running = F.sum("_break").over(seq.rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("_run", running)
            .join(cells.select(SLICE, *keys, "_start"), [SLICE, *keys])
            .withColumn("session", F.col("_start") + F.col("_run"))
            .drop("_break", "_run", "_start", SLICE))


def flow_totals(time: str = "ts", row_id: str = "row_id") -> list:
    """Aggregates of one flow; the first packet decides which end is the source."""
    first = F.min_by("forward", F.struct(time, row_id))

    def side(forward: bool):
        return F.col("forward") == F.lit(forward)

    out = [first.alias("_first"), F.min(time).alias("stime"), F.max(time).alias("ltime")]
    for name, flag in (("f", True), ("b", False)):
        out += [F.count(F.when(side(flag), 1)).alias(f"_{name}_pkts"),
                F.coalesce(F.sum(F.when(side(flag), F.col("bytes"))), F.lit(0)).cast("bigint")
                .alias(f"_{name}_bytes")]
    return out


def orient(flows: DataFrame) -> DataFrame:
    """Name the ends and directions by the first packet."""
    fwd = F.col("_first")

    def pick(yes: str, no: str):
        return F.when(fwd, F.col(yes)).otherwise(F.col(no))

    return flows.select(
        pick("a_ip", "b_ip").alias("src_ip"), pick("b_ip", "a_ip").alias("dst_ip"),
        pick("a_port", "b_port").alias("src_port"), pick("b_port", "a_port").alias("dst_port"),
        "protocol", "stime", "ltime",
        ((F.col("ltime") - F.col("stime")) / F.lit(1000.0)).alias("dur"),
        pick("_f_pkts", "_b_pkts").alias("src_pkts"), pick("_b_pkts", "_f_pkts").alias("dst_pkts"),
        pick("_f_bytes", "_b_bytes").alias("src_ip_bytes"),
        pick("_b_bytes", "_f_bytes").alias("dst_ip_bytes"))


def assemble_flows(packets: DataFrame, gap_ms: int = 120000, time: str = "ts",
                   row_id: str = "row_id", slices: int | None = None) -> DataFrame:
    """One row per conversation and session, both directions counted."""
    keyed = canonical_key(packets)
    sessions = number_sessions(keyed, KEY, gap_ms, time, row_id, slices)
    return orient(sessions.groupBy(*KEY, "session").agg(*flow_totals(time, row_id)))

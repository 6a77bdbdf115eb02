"""Base flows to the enriched feature tables, each one lazy plan around one wide exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import normalize as N
from flowloom.functions import signal as G
from flowloom.operators.contracts import required
from flowloom.operators.counters import file_order, running_bytes, running_count
from flowloom.operators.damped import Stat, damped, damped_in_sequence, in_sequence
from flowloom.operators.prefix import SLICE, spread, time_slices
from flowloom.session import materialize

_SIGNAL = ["src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts"]
_SIGNAL_DASHED = ["src-ip-bytes", "dst-ip-bytes", "src2dst_packets", "dst2src_packets"]

# fixed values: the damped columns and their decay rates (per second)
H_STATS = [Stat("H_L0.01_weight", 0.01, "weight"), Stat("H_L0.1_weight", 0.1, "weight"),
           Stat("H_L1_weight", 1.0, "weight"), Stat("H_L3_weight", 3.0, "weight"),
           Stat("H_L0.01_mean", 0.01, "mean")]
MI_STATS = [Stat("MI_dir_L0.01_weight", 0.01, "weight"), Stat("MI_dir_L0.1_weight", 0.1, "weight"),
            Stat("MI_dir_L1_weight", 1.0, "weight"), Stat("MI_dir_L0.1_mean", 0.1, "mean")]
JITTER_STATS = [Stat("HH_jit_L1_mean", 1.0, "mean")]

FILE_ORDER = ["file_no", "stime", "row_id"]


def add_pair(df: DataFrame, a: str = "src_ip", b: str = "dst_ip") -> DataFrame:
    """Unordered address pair as two columns."""
    return df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})


def source_damped(rows: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return damped(rows, ["src_ip"], F.col("src_ip_bytes") + F.col("dst_ip_bytes"), H_STATS,
                  source=source)


def direction_damped(rows: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return damped(rows, ["src_ip", "dst_ip"], F.col("src_ip_bytes"), MI_STATS, source=source)


def jitter_damped(rows: DataFrame) -> DataFrame:
    return damped(rows, ["_lo", "_hi"], None, JITTER_STATS)


def by_file(flows: DataFrame, files: DataFrame | None = None, file: str = "source_file") -> DataFrame:
    """Rows in the order of their files, then time, then row id; ``files`` gives file numbers.

    Without ``files`` they are numbered by the time of their first row.
    """
    files = file_order(flows, file) if files is None else files
    # written: planned as large, the few files would have the rows dealt by file, a whole file to one task
    files = materialize(files.select(file, "file_no"), "files")
    return in_sequence(flows.join(files, file), FILE_ORDER)


def file_damped(source: DataFrame) -> DataFrame:
    """All damped columns over rows from :func:`by_file`: state runs on from file to file."""
    source = add_pair(source)
    rows = spread(source)
    total = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    for keys, value, stats in ((["src_ip"], total, H_STATS), (["src_ip", "dst_ip"], F.col("src_ip_bytes"), MI_STATS),
                               (["_lo", "_hi"], None, JITTER_STATS)):
        rows = damped_in_sequence(rows, keys, value, stats, FILE_ORDER, source=source)
    return rows


def enrich(base: DataFrame, keep: tuple[str, ...] = (), slices: int | None = None,
           file_sequence: bool = False) -> DataFrame:
    """The 34-column table; ``keep`` adds columns such as ``row_id`` in front.

    Rows run in the order (time, row id) over all files.  ``file_sequence`` takes one file after the other
    instead, by the time of their first row, so that time goes back where files overlap.
    """
    flows = required(base, S.REQUIRED)
    if file_sequence:
        source = by_file(flows, file_order(base))
        rows = file_damped(source)
        rows = running_count(rows, ["source_file", "src_ip"], "N_IN_Conn_P_SrcIP", source, FILE_ORDER)
        rows = running_count(rows, ["source_file", "dst_ip"], "N_IN_Conn_P_DstIP", source, FILE_ORDER)
        rows = running_bytes(rows, "dst_ip", F.col("src_ip_bytes") + F.col("dst_ip_bytes"), "TnBPDstIP",
                             source, FILE_ORDER)
        return _finished(rows, keep)
    source = add_pair(time_slices(flows, slices=slices))
    rows = spread(source)
    rows = source_damped(rows, source)
    rows = direction_damped(rows, source)
    rows = jitter_damped(rows)
    rows = running_count(rows, ["source_file", "src_ip"], "N_IN_Conn_P_SrcIP", source)
    rows = running_count(rows, ["source_file", "dst_ip"], "N_IN_Conn_P_DstIP", source)
    rows = running_bytes(rows, "dst_ip", (F.col("src_ip_bytes") + F.col("dst_ip_bytes")),
                         "TnBPDstIP", source)
    return _finished(rows, keep)


def _finished(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    stats = G.stats(G.signal(*[F.col(c) for c in _SIGNAL]))
    rows = rows.withColumns({
        **stats, "TnBPDstIP": F.col("TnBPDstIP").cast("double"),
        "state_number": N.coded(F.col("conn_state"), S.STATE_CODES, -1),
        "proto_number": N.coded(F.col("proto"), S.PROTO_CODES, -1)})
    return rows.select(*keep, *[F.col(f"`{c}`") for c in S.ENRICHED])


def _dashed_features(rows: DataFrame) -> dict:
    v = G.signal(*[F.col(c) for c in _SIGNAL_DASHED])
    stats = G.stats(v)
    state = N.state_from_packets(F.col("src2dst_packets"), F.col("dst2src_packets"))
    return {**G.wavelet_features(v), **{k: stats[k] for k in ("max", "mean", "min", "stddev")},
            "src-bytes": F.col("src-ip-bytes"), "src-pkts": F.col("src2dst_packets"),
            "proto": F.col("protocol"), "proto-number": F.col("protocol"), "conn-state": state,
            "state-number": N.coded(state, S.STATE_CODES_DASHED, 0)}


def _counted(flows: DataFrame, per_file: bool, slices: int | None) -> DataFrame:
    source = time_slices(flows, slices=slices)
    rows = spread(source)
    scope = ["source_file"] if per_file else []
    rows = running_count(rows, [*scope, "src-ip"], "N-IN-Conn-P-SrcIP", source)
    return running_count(rows, [*scope, "dst-ip"], "N-IN-Conn-P-DstIP", source)


def enrich_dashed(base: DataFrame, keep: tuple[str, ...] = (),
                  slices: int | None = None) -> DataFrame:
    """The 26-column table with wavelet and entropy features."""
    rows = _counted(required(base, S.REQUIRED_DASHED), True, slices)
    rows = rows.withColumns(_dashed_features(rows))
    return rows.select(*keep, *[F.col(f"`{c}`") for c in S.ENRICHED_DASHED])


def enrich_unfiltered(base: DataFrame, keep: tuple[str, ...] = (),
                      slices: int | None = None) -> DataFrame:
    """The earlier 25-column variant: no required-field filter, name-service columns kept."""
    rows = _counted(base, True, slices)
    rows = rows.withColumns(_dashed_features(rows))
    return rows.select(*keep, *[F.col(f"`{c}`") for c in S.ENRICHED_UNFILTERED])


def counter_table(base: DataFrame, keep: tuple[str, ...] = (),
                  slices: int | None = None) -> DataFrame:
    """Ten columns straight from flows; the counters run across all files."""
    rows = _counted(base, False, slices)
    rows = rows.withColumns(_dashed_features(rows))
    return rows.select(*keep, *[F.col(f"`{c}`") for c in S.COUNTER_TABLE])

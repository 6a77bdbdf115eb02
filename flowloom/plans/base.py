"""Raw flow fields to the normalised base table, in both column conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import normalize as N


def base_table(raw: DataFrame) -> DataFrame:
    """19 columns plus the row id and source file that keep the order and the provenance."""
    c = F.col
    return raw.select(
        "row_id", "source_file",
        N.falsy_default(c("src_ip"), "0.0.0.0").alias("src_ip"),
        N.falsy_default(c("dst_ip"), "0.0.0.0").alias("dst_ip"),
        N.falsy_default(c("src_port"), 0).alias("src_port"),
        N.falsy_default(c("dst_port"), 0).alias("dst_port"),
        N.proto_name(c("protocol")).alias("proto"), "stime", "ltime",
        F.coalesce(N.ms_to_seconds(c("duration_ms")), F.lit(0.0)).alias("dur"),
        N.falsy_default(c("dns_query"), "").alias("dns_query"),
        N.flag_text(c("dns_rejected")).alias("dns_rejected"),
        N.flag_text(c("dns_rd")).alias("dns_RD"),
        N.derive_conn_state(c("connection_state"), c("src_pkts"), c("dst_pkts"))
        .alias("conn_state"),
        N.derive_service(c("requested_service"), c("application_name")).alias("service"),
        "http_status_code", "src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "label")


def base_table_dashed(raw: DataFrame) -> DataFrame:
    """17 columns in the dashed convention, plus row id and source file."""
    c = F.col
    return raw.select(
        "row_id", "source_file",
        N.falsy_default(c("src_ip"), "0.0.0.0").alias("src-ip"),
        N.falsy_default(c("dst_ip"), "0.0.0.0").alias("dst-ip"),
        N.falsy_default(c("src_port"), 0).alias("src-port"),
        N.falsy_default(c("dst_port"), 0).alias("dst-port"),
        N.falsy_default(c("protocol"), 0).alias("protocol"), "stime",
        F.coalesce(c("dns_query"), F.lit("")).alias("dns-query"),
        N.flag_int(c("dns_rejected")).alias("dns-rejected"),
        N.flag_int(c("dns_rd")).alias("dns-RD"),
        F.coalesce(c("connection_state"), F.lit("OTH")).alias("state"),
        F.coalesce(c("requested_service"), F.lit("-")).alias("service"),
        F.coalesce(c("http_status_code"), F.lit(-1)).alias("http-status-code"),
        c("src_ip_bytes").alias("src-ip-bytes"), c("dst_ip_bytes").alias("dst-ip-bytes"),
        c("src_pkts").alias("src2dst_packets"), c("dst_pkts").alias("dst2src_packets"), "label")


def none_as_null(base: DataFrame) -> DataFrame:
    """Option: read the literal ``None`` sentinel as a missing value, as a CSV reader may."""
    return base.withColumns({c: F.nullif(F.col(c), F.lit("None")) for c in S.CATEGORICAL})

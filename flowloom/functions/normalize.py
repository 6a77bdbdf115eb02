"""Column expressions that map raw flow fields to the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falsy_default(c: Column, default) -> Column:
    """A missing, zero or empty value becomes ``default``."""
    zero = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(c, F.lit(zero)), F.lit(default))


def proto_name(number: Column) -> Column:
    return (F.when(number.isNull(), "None").when(number == 6, "tcp")
            .when(number == 17, "udp").otherwise("Other"))


def flag_text(flag: Column) -> Column:
    return F.when(flag.isNull(), "-").when(flag, "T").otherwise("F")


def flag_int(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(0))


def closed_vocab(c: Column, allowed: list[str]) -> Column:
    """Missing -> ``None``, a known value stays, anything else -> ``Other``.

    The outer coalesce changes no value; it tells the optimizer that the result is never null, so
    that a later required-field check on it costs nothing.
    """
    kept = F.when(c.isNull() | (c == ""), "None").when(c.isin(allowed), c).otherwise("Other")
    return F.coalesce(kept, F.lit("Other"))


def conn_state_vocab(c: Column) -> Column:
    return closed_vocab(c, ["S0", "SF", "REJ", "OTH"])


def service_vocab(c: Column) -> Column:
    return closed_vocab(c, ["-", "dns", "http"])


def state_from_packets(src: Column, dst: Column, two_way: str = "SF") -> Column:
    src, dst = F.coalesce(src, F.lit(0)), F.coalesce(dst, F.lit(0))
    return (F.when((src > 0) & (dst == 0), "S0").when((src > 0) & (dst > 0), two_way)
            .otherwise("OTH"))


def derive_conn_state(upstream: Column, src_pkts: Column, dst_pkts: Column) -> Column:
    given = upstream.isNotNull() & (upstream != "")
    return F.when(given, conn_state_vocab(upstream)).otherwise(
        state_from_packets(src_pkts, dst_pkts))


def derive_service(upstream: Column, application: Column) -> Column:
    app = F.lower(application)
    by_name = (F.when(application.isNull() | (application == ""), "None")
               .when(app.contains("dns"), "dns").when(app.contains("http"), "http")
               .when(app.isin("unknown", "unrated"), "-").otherwise("Other"))
    return F.when(upstream.isNotNull() & (upstream != ""), service_vocab(upstream)).otherwise(
        by_name)


def coded(c: Column, codes: dict[str, int], default: int | None = None) -> Column:
    """Look a value up in a small fixed code table; it folds into the plan as a CASE."""
    out = None
    for value, code in codes.items():
        out = F.when(c == value, code) if out is None else out.when(c == value, code)
    return out if default is None else out.otherwise(default)


def binary_category(label: Column) -> Column:
    """0 for the benign class, 1 for anything else, a missing label included."""
    return F.when(F.lower(label) == "normal", 0).otherwise(1)


def flow_key(src: Column, dst: Column, sport: Column, dport: Column, proto: Column) -> Column:
    return F.concat_ws("-", src, dst, sport.cast("string"), dport.cast("string"),
                       proto.cast("string"))


def ms_to_seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def seeded_key(seed: int | Column, *ids: Column) -> Column:
    """The pseudo-random sort key every seeded draw uses."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", *[i.cast("string") for i in ids], seed.cast("string")))

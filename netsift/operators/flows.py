"""Flow statistics and traffic windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.network import is_common_port, is_private_ip, is_well_known_port, safe_ratio
from netsift.operators.ordering import epoch_micros, seconds_to_micros
from netsift.schemas import FLAG_NAMES

FLOW_KEY = ["protocol", "src_ip", "src_port", "dst_ip", "dst_port"]

# Protocols that get a count or ratio column of their own.
PROTOCOLS = ["TCP", "UDP", "ICMP"]


def _flag(name: str) -> Column:
    return (F.col("protocol") == "TCP") & F.col(f"tcp_flags.{name}")


def flow_keys(df: DataFrame, bidirectional: bool = False) -> DataFrame:
    """Fill missing key parts; ``bidirectional`` puts the greater (address, port) first."""
    df = df.withColumns(
        {
            "protocol": F.coalesce("protocol", F.lit("UNKNOWN")),
            "src_ip": F.coalesce("src_ip", F.lit("0.0.0.0")),
            "dst_ip": F.coalesce("dst_ip", F.lit("0.0.0.0")),
            "src_port": F.coalesce("src_port", F.lit(0)),
            "dst_port": F.coalesce("dst_port", F.lit(0)),
        }
    )
    if not bidirectional:
        return df
    swap = ~(F.struct("src_ip", "src_port") > F.struct(F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port")))

    def pick(a: str, b: str) -> Column:
        return F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a))

    return (
        df.withColumn("_swap", swap)
        .withColumns(
            {
                "src_ip": pick("src_ip", "dst_ip"),
                "src_port": pick("src_port", "dst_port"),
                "dst_ip": pick("dst_ip", "src_ip"),
                "dst_port": pick("dst_port", "src_port"),
            }
        )
        .drop("_swap")
    )


def flow_aggregates(ts: str = "ts", protocols: Sequence[str] = PROTOCOLS) -> list[Column]:
    """The sums behind :func:`flow_features`; all combine before the shuffle."""
    return [
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.coalesce("length", F.lit(0)).cast("long")).alias("byte_count"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("last_time"),
        *[F.count_if(_flag(f)).alias(f"tcp_{f}_count") for f in FLAG_NAMES],
        *[F.count_if(F.col("protocol") == p).alias(f"protocol_{p.lower()}_count") for p in protocols],
    ]


def flow_rates(flows: DataFrame) -> DataFrame:
    """Durations, rates and flag ratios from the sums of a flow."""
    seconds = (epoch_micros("last_time") - epoch_micros("start_time")) / F.lit(1e6)
    return (
        flows.withColumn("flow_duration", seconds)
        .withColumn("packets_per_second", safe_ratio("packet_count", "flow_duration"))
        .withColumn("bytes_per_second", safe_ratio("byte_count", "flow_duration"))
        .withColumn("syn_fin_ratio", safe_ratio("tcp_syn_count", "tcp_fin_count"))
        .withColumn("syn_rst_ratio", safe_ratio("tcp_syn_count", "tcp_rst_count"))
    )


def flow_features(
    df: DataFrame, bidirectional: bool = False, ts: str = "ts", protocols: Sequence[str] = PROTOCOLS
) -> DataFrame:
    """One row per flow: counts, bytes, times, rates, TCP flags and protocol counts."""
    keyed = flow_keys(df, bidirectional)
    return flow_rates(keyed.groupBy(*FLOW_KEY).agg(*flow_aggregates(ts, protocols)))


def advanced_flow_features(flows: DataFrame) -> DataFrame:
    """Flags for private addresses, well-known and common ports (0/1; NULL for bad addresses)."""
    return flows.withColumns(
        {
            "src_ip_is_private": is_private_ip("src_ip").cast("int"),
            "dst_ip_is_private": is_private_ip("dst_ip").cast("int"),
            "src_port_is_well_known": is_well_known_port("src_port").cast("int"),
            "dst_port_is_well_known": is_well_known_port("dst_port").cast("int"),
            "src_port_is_common": is_common_port("src_port").cast("int"),
            "dst_port_is_common": is_common_port("dst_port").cast("int"),
        }
    )


def _present(name: str, kind: str) -> Column:
    """A value that counts as distinct: not NULL, not empty, not 0."""
    col = F.col(name)
    return F.when(col != ("" if kind == "ip" else 0), col)


UNIQUES = {
    "unique_src_ips": ("src_ip", "ip"),
    "unique_dst_ips": ("dst_ip", "ip"),
    "unique_src_ports": ("src_port", "port"),
    "unique_dst_ports": ("dst_port", "port"),
}


def size_aggregates() -> list[Column]:
    length = F.coalesce("length", F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("packet_count"),
        F.avg(length).alias("avg_packet_size"),
        F.stddev_pop(length).alias("std_packet_size"),
        F.min(length).alias("min_packet_size"),
        F.max(length).alias("max_packet_size"),
    ]


def protocol_aggregates(protocols: Sequence[str] = PROTOCOLS) -> list[Column]:
    total = F.count(F.lit(1))
    return [(F.count_if(F.col("protocol") == p) / total).alias(f"protocol_{p.lower()}_ratio") for p in protocols]


def flag_aggregates() -> list[Column]:
    tcp = F.count_if(F.col("protocol") == "TCP")
    return [safe_ratio(F.count_if(_flag(f)), tcp).alias(f"tcp_{f}_ratio") for f in FLAG_NAMES]


def _window(df: DataFrame, ts: str, width: str, slide: str | None) -> Column:
    return F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)


def window_summary(
    df: DataFrame, width: str, slide: str | None = None, ts: str = "ts", keys: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Packet count, sizes and distinct addresses and ports per time window.

    Exact distinct counts are taken one column at a time: each is a plain
    two-step aggregate, and a busy window is spread by the counted values.
    """
    windowed = df.withColumn("_w", _window(df, ts, width, slide))
    by = [*keys, "_w"]
    if approximate:
        uniques = [F.approx_count_distinct(_present(c, k)).alias(n) for n, (c, k) in UNIQUES.items()]
        out = windowed.groupBy(*by).agg(*size_aggregates(), *uniques)
    else:
        # one narrow row per window, kind and value; combined before the shuffle
        kinds = F.array(
            *[F.struct(F.lit(n).alias("kind"), _present(c, k).cast("string").alias("value")) for n, (c, k) in UNIQUES.items()]
        )
        seen = (
            windowed.select(*by, F.explode(kinds).alias("_u"))
            .where(F.col("_u.value").isNotNull())
            .groupBy(*by, "_u")
            .agg(F.lit(1).alias("_one"))
            .groupBy(*by)
            .agg(*[F.count_if(F.col("_u.kind") == n).alias(n) for n in UNIQUES])
        )
        sizes = windowed.groupBy(*by).agg(*size_aggregates())
        # null-safe: packets without a key are a group of their own
        seen = seen.select(*[F.col(c).alias(f"_seen_{c}") for c in by], *UNIQUES)
        on = [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in by]
        out = sizes.join(seen, on, "left").drop(*[f"_seen_{c}" for c in by]).fillna(0, list(UNIQUES))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[
        c for c in out.columns if c not in by
    ])


def protocol_ratios(
    df: DataFrame, width: str, slide: str | None = None, ts: str = "ts", protocols: Sequence[str] = PROTOCOLS
) -> DataFrame:
    """Share of each protocol per time window."""
    out = df.groupBy(_window(df, ts, width, slide).alias("_w")).agg(*protocol_aggregates(protocols))
    return out.select(F.col("_w.start").alias("window_start"), *[c for c in out.columns if c != "_w"])


def flag_ratios(df: DataFrame, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Share of TCP packets with each flag per time window (0 without TCP packets)."""
    out = df.groupBy(_window(df, ts, width, slide).alias("_w")).agg(*flag_aggregates())
    return out.select(F.col("_w.start").alias("window_start"), *[c for c in out.columns if c != "_w"])


def _trailing_block(rows: pd.DataFrame, span: int, sums: Sequence[str]) -> pd.DataFrame:
    """The trailing windows of a block's own packets (``_own``), which reach into the block before (the other rows).

    A packet's window holds the own packets up to its time and those of the block before from ``span`` earlier on.
    Distinct counts: a value counts from a packet until the next packet with that value, or until it leaves the
    window; as many have begun less as have ended by a packet's time. Rows that share an id are one.
    """
    rows = rows.sort_values("_us", kind="stable", ignore_index=True)
    us, is_own = rows["_us"].to_numpy(dtype=np.int64), rows["_own"].to_numpy(dtype=bool)
    own, ctx = rows[is_own], rows[~is_own]
    at = us[is_own]
    upto = np.searchsorted(at, at, "right") - 1
    since = np.searchsorted(us[~is_own], at - span, "left")
    own_lens, ctx_lens = own["_len"].to_numpy(dtype=np.int64), ctx["_len"].to_numpy(dtype=np.int64)
    limit = np.iinfo(np.int64)
    ups = {"_n": upto + 1, "_min": np.minimum.accumulate(own_lens)[upto], "_max": np.maximum.accumulate(own_lens)[upto]}
    # no packet in that part of the window: an extreme that the other part's always beats
    backs = {
        "_n": len(ctx) - since,
        "_min": np.append(np.minimum.accumulate(ctx_lens[::-1])[::-1], limit.max)[since],
        "_max": np.append(np.maximum.accumulate(ctx_lens[::-1])[::-1], limit.min)[since],
    }
    for c in sums:
        before = np.append(0, ctx[c].to_numpy(dtype=np.int64).cumsum())
        ups[c], backs[c] = own[c].to_numpy(dtype=np.int64).cumsum()[upto], before[-1] - before[since]
    for n in UNIQUES:
        codes = pd.factorize(rows[f"_u_{n}"])[0]
        has = codes >= 0
        codes, begin = codes[has], us[has]
        order = np.argsort(codes, kind="stable")
        end = begin + span + 1
        again = codes[order][1:] == codes[order][:-1]
        end[order[:-1][again]] = np.minimum(end[order[:-1][again]], begin[order[1:][again]])
        end.sort()
        ups[n] = np.searchsorted(begin, at, "right") - np.searchsorted(end, at, "right")
    ids = own[["_id", "_no_id"]].reset_index(drop=True)
    ups, backs = pd.DataFrame(ups), pd.DataFrame(backs)
    if ids["_id"].duplicated().any():
        one = [ids["_no_id"], ids["_id"]]
        backs["_min"] = backs["_min"].where(backs["_n"] > 0, limit.min)
        ups, backs = (x.groupby(one, dropna=False, sort=False).max().reset_index(drop=True) for x in (ups, backs))
        backs["_min"] = backs["_min"].where(backs["_n"] > 0, limit.max)
        ids = ids[~ids.duplicated()].reset_index(drop=True)
    out = ids.assign(**{c: ups[c] + backs[c] for c in ["_n", *sums]}, **{n: ups[n] for n in UNIQUES})
    return out.assign(min_packet_size=np.minimum(ups["_min"], backs["_min"]), max_packet_size=np.maximum(ups["_max"], backs["_max"]))


def trailing_features(
    df: DataFrame,
    seconds: float,
    keys: Sequence[str],
    row_id: str,
    ts: str = "ts",
    protocols: Sequence[str] = PROTOCOLS,
) -> DataFrame:
    """Traffic summary of each packet's trailing window (both ends included).

    Time is cut into blocks as long as the window. A packet's window is then
    the end of the block before and the start of its own, so each packet is
    sent to two blocks and every figure comes from running sums, minima and
    maxima (:func:`_trailing_block`): the cost per packet does not grow with the
    traffic density, and a busy key is spread over its blocks. One shuffle by
    (keys, block); a block is a few arrays of numbers in a task.
    """
    span = seconds_to_micros(seconds)
    keys = list(keys)
    length = F.coalesce("length", F.lit(0)).cast("long")
    flags = {f"tcp_{f}_ratio": F.coalesce(_flag(f), F.lit(False)).cast("long") for f in FLAG_NAMES}
    shares = {f"protocol_{p.lower()}_ratio": F.coalesce(F.col("protocol") == p, F.lit(False)).cast("long") for p in protocols}
    id_type = df.schema[row_id].dataType
    # whole numbers with nulls would become floats in a task
    own_id = F.coalesce(F.col(row_id), F.lit(0).cast(id_type)) if isinstance(id_type, T.IntegralType) else F.col(row_id)
    base = df.select(
        own_id.alias("_id"),
        F.col(row_id).isNull().alias("_no_id"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        epoch_micros(ts).alias("_us"),
        length.alias("_len"),
        (length * length).alias("_sq"),
        F.coalesce(F.col("protocol") == "TCP", F.lit(False)).cast("long").alias("_tcp"),
        *[v.alias(f"_f_{n}") for n, v in {**flags, **shares}.items()],
        *[_present(c, k).cast("string").alias(f"_u_{n}") for n, (c, k) in UNIQUES.items()],
    )
    ks = [f"_k_{k}" for k in keys]
    block = F.floor(F.col("_us") / F.lit(span)).cast("long")
    blocks = (
        base.withColumn("_home", block)
        .withColumn("_block", F.explode(F.sequence(F.col("_home"), F.col("_home") + 1)))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )
    sums = ["_len", "_sq", "_tcp", *[f"_f_{n}" for n in [*flags, *shares]]]
    counts = ["_n", *sums, "min_packet_size", "max_packet_size", *UNIQUES]
    kept = T.StructType(
        [T.StructField("_id", id_type), T.StructField("_no_id", T.BooleanType())]
        + [T.StructField(f"_k_{k}", df.schema[k].dataType) for k in keys]
        + [T.StructField(c, T.LongType()) for c in counts]
    )

    def summarise(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _trailing_block(frame, span, sums)
        for k, value in zip(ks, group, strict=False):
            out[k] = pd.Series([value] * len(out), index=out.index, dtype=object)
        return out[["_id", "_no_id", *ks, *counts]]

    joined = blocks.groupBy(*ks, "_block").applyInPandas(summarise, kept).withColumn("_id", F.when(~F.col("_no_id"), F.col("_id")))
    n = F.col("_n").cast("double")
    mean = F.col("_len") / n
    exact = [F.col(c).cast("decimal(19,0)") for c in ("_n", "_sq", "_len")]
    spread = (exact[0] * exact[1] - exact[2] * exact[2]).cast("double")
    return joined.select(
        F.col("_id").alias(row_id),
        *[F.col(f"_k_{k}").alias(k) for k in keys],
        F.col("_n").alias("packet_count"),
        mean.alias("avg_packet_size"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("std_packet_size"),
        "min_packet_size",
        "max_packet_size",
        *UNIQUES,
        *[(F.col(f"_f_{c}") / n).alias(c) for c in shares],
        *[safe_ratio(f"_f_{c}", "_tcp").alias(c) for c in flags],
    )

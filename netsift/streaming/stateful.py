"""Keyed state on streams: rate rules, moving thresholds, de-bouncing, detection.

Only the few columns a rule needs reach the Python workers, and each batch of
a key is one numpy pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netsift.functions.alerts import alert_envelope
from netsift.operators import rules as R
from netsift.operators.ordering import epoch_micros, seconds_to_micros


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Chained state needs the RocksDB store: a session that still has Spark's default store gets it, another choice is an error."""
    now = spark.conf.get(PROVIDER)
    if now != ROCKSDB and not now.endswith("HDFSBackedStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    spark.conf.set(PROVIDER, ROCKSDB)


def _in_window(times: np.ndarray, us: np.ndarray, span: int) -> np.ndarray:
    """How many of the sorted times lie in the ``span`` up to each of ``us``, ends included."""
    return np.searchsorted(times, us, "right") - np.searchsorted(times, us - span, "left")


def _busy_marks(keys: pd.Series, us: np.ndarray, count: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """``sure`` and ``counted``, as :func:`thin_busy_keys` has them, of the rows of one rule."""
    order = np.lexsort((us, codes := pd.factorize(keys)[0]))
    us, codes = us[order], codes[order]
    sure, counted = np.zeros(len(us), dtype=bool), np.zeros(len(us), dtype=bool)
    cuts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(us))
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        times = us[start:end]
        stretch, at = times // max(span, 1), np.arange(end - start)
        first, last = np.searchsorted(stretch, stretch, "left"), np.searchsorted(stretch, stretch, "right")
        sure[order[start:end]] = _in_window(times, times, span) >= count
        counted[order[start:end]] = (at - first < count) | (last - at <= count)
    return sure, counted


def thin_busy_keys(narrow: DataFrame, count: int | dict[int, int], span: int | dict[int, int], rule: str | None = None) -> DataFrame:
    """Mark what a batch of rows (``track_key``, ``us``) already decides: adds ``sure`` and ``counted``.

    A packet with ``count`` packets of its key in its own batch of rows is ``sure`` wherever it goes on. The
    others' windows need no more of them than the first and last ``count`` of each stretch of ``span``, which
    are ``counted``: a window covers the end of one stretch and the start of the next. So a busy key sends
    a bounded number of rows per stretch and batch to its state, however many packets it has.

    With ``rule``, a column of whole numbers, the rows of each rule are told apart, and counts and spans are by rule.
    """

    @F.pandas_udf("sure boolean, counted boolean")
    def marked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, us, rules in batches:
            times, numbers = us.to_numpy(dtype=np.int64), rules.to_numpy()
            out = pd.DataFrame({"sure": np.zeros(len(us), dtype=bool), "counted": np.zeros(len(us), dtype=bool)})
            for number in np.unique(numbers).tolist():
                own = np.flatnonzero(numbers == number)
                limits = (count, span) if rule is None else (count[number], span[number])
                out.iloc[own, 0], out.iloc[own, 1] = _busy_marks(keys.iloc[own], times[own], *limits)
            yield out

    # what it gives depends on how the rows fall into batches
    return narrow.withColumn("_marks", marked.asNondeterministic()("track_key", "us", F.lit(0) if rule is None else F.col(rule))).select("*", "_marks.*").drop("_marks")


def _decide(old: np.ndarray, us: np.ndarray, count: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a key's new packets are hits, and the times to keep: the last ``count - 1`` that are not too old."""
    times = np.sort(np.concatenate([old, us]))
    hit = _in_window(times, us, span) >= count
    kept = times[times >= times[-1] - span]
    return hit, kept[max(len(kept) - count + 1, 0) :]


class RateProcessor(StatefulProcessor):
    """State of a rule and key: a list of at most ``count - 1`` times. A timer drops it once event time has passed them.

    A key has one timer at a time: it is set with the first times of a list, and set again where it finds later ones.
    """

    def __init__(self, row_id: str, limits: dict[int, tuple[int, int]]) -> None:
        self.row_id, self.limits = row_id, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (count, span), frames = self.limits[int(key[0])], list(rows)
        new = frames[0] if len(frames) == 1 else pd.concat(frames)
        us = new["us"].to_numpy(dtype=np.int64)
        old = np.array([t for (t,) in self.times.get()], dtype=np.int64)
        hit, kept = _decide(old, us, count, span)
        if len(kept):
            self.times.put([(int(t),) for t in kept])
            if not len(old):
                self.handle.registerTimer(max((int(kept[-1]) + span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        elif len(old):
            self.times.clear()
        hit &= ~new["sure"].to_numpy(dtype=bool)
        if hit.any():
            yield pd.DataFrame({"_rule": int(key[0]), "track_key": key[1], self.row_id: new[self.row_id].to_numpy()[hit], "ts": new["ts"].to_numpy()[hit]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [t for (t,) in self.times.get()]
        due = (max(times) + self.limits[int(key[0])][1]) // 1000 + 1 if times else 0
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        elif times:
            self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def _rate_hits(stream: DataFrame, rates: dict[int, tuple[str, int, float, Column | None]], row_id: str, ts: str) -> DataFrame:
    """Hits ``(_rule, track_key, row id, ts)`` of rate rules ``{number: (track_by, count, seconds, gate)}``, as :func:`rate_stream` has them.

    A packet is read once and gives a narrow row for each rule whose gate it passes; all rules share one step with state.
    """
    port = F.col("dst_port").cast("string")
    keys = {
        "ip": F.col("src_ip"),
        "port": port,
        "ip_port": F.concat(F.coalesce("src_ip", F.lit("")), F.lit(":"), F.coalesce(port, F.lit(""))),
    }
    counts = {number: max(int(count), 1) for number, (_, count, _, _) in rates.items()}
    spans = {number: seconds_to_micros(seconds) for number, (_, _, seconds, _) in rates.items()}
    asked = []
    for number, (track_by, _, _, gate) in rates.items():
        own = keys[track_by] if gate is None else F.when(F.coalesce(gate, F.lit(False)), keys[track_by])
        asked.append(F.struct(F.lit(number).alias("_rule"), own.alias("track_key")))
    narrow = stream.select(F.col(row_id), F.col(ts).alias("ts"), epoch_micros(ts).alias("us"), F.explode(F.array(*asked)).alias("_asked"))
    narrow = narrow.select("_asked._rule", "_asked.track_key", row_id, "ts", "us")
    marked = thin_busy_keys(narrow.where((F.col("track_key") != "") & F.col("us").isNotNull()), counts, spans, "_rule")
    sure = marked.where("sure").select("_rule", "track_key", row_id, "ts")
    open_rows = marked.where("counted OR NOT sure").groupBy("_rule", "track_key")
    id_field = stream.schema[row_id]
    out = T.StructType([T.StructField("_rule", T.IntegerType()), T.StructField("track_key", T.StringType()), id_field, T.StructField("ts", T.TimestampType())])
    if stream.sparkSession.conf.get(PROVIDER) == ROCKSDB:
        limits = {number: (counts[number], spans[number]) for number in rates}
        found = open_rows.transformWithStateInPandas(RateProcessor(row_id, limits), out, "Append", "EventTime", eventTimeColumnName="ts")
        return sure.union(found)
    kept = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, span = pd.concat(list(frames)), spans[int(group[0])]
        old = np.array(state.get[0] if state.exists else [], dtype=np.int64)
        hit, times = _decide(old, rows["us"].to_numpy(dtype=np.int64), counts[int(group[0])], span)
        state.update((times.tolist(),))
        last = int(times[-1]) + span if len(times) else 0
        state.setTimeoutTimestamp(max(last // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        found = rows[hit & ~rows["sure"].to_numpy(dtype=bool)]
        yield pd.DataFrame({"_rule": int(group[0]), "track_key": group[1], row_id: found[row_id].to_numpy(), "ts": found["ts"].to_numpy()})

    return sure.union(open_rows.applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout))


def rate_stream(
    stream: DataFrame, track_by: str, count: int, seconds: float, row_id: str = "packet_id", ts: str = "ts"
) -> DataFrame:
    """Packets that complete ``count`` packets of their key in ``seconds``: (key, row id, ts).

    Batches of rows decide busy keys on their own (:func:`thin_busy_keys`); the state of a key
    is its last ``count - 1`` packet times of the last ``seconds``. Within a batch packets count
    in time order, those of the same instant for each other; a late packet is compared with the
    times still kept. With the RocksDB store the result may feed further stateful steps.
    """
    return _rate_hits(stream, {0: (track_by, count, seconds, None)}, row_id, ts).drop("_rule")


class EwmaProcessor(StatefulProcessor):
    """A feature's state is its mean and variance. It may start from a saved row, and is dropped when unused for the given time."""

    def __init__(self, key: str, tie: str, alpha: float, k: float, unused_ms: int | None) -> None:
        self.key, self.tie, self.alpha, self.k, self.unused_ms = key, tie, alpha, k, unused_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "m double, s double", self.unused_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        if pd.notna(row["ewma"]):
            self.level.update((float(row["ewma"]), float(row["ewmvar"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        after = self.level.get() if self.level.exists() else None
        for out, after in ewma_parts(rows, after, self.key, key[0], self.tie, self.alpha, self.k):
            yield out
        self.level.update(after)

    def close(self) -> None:
        pass


def ewma_parts(
    frames: Iterator[pd.DataFrame], state: tuple | None, key: str, name, tie: str, alpha: float, k: float, size: int = 1 << 17
) -> Iterator[tuple[pd.DataFrame, tuple[float, float]]]:
    """One batch of a feature as :func:`ewma_rows` has it, at most ``size`` rows at a time, with the state after each part.

    Of a row only time, tie and value are held, as numbers; the key's strings and the results never meet whole.
    """
    held = [[], [], []]
    for frame in frames:
        for column, name_of in zip(held, ("us", tie, "value"), strict=True):
            column.append(frame[name_of].to_numpy(copy=True))
    us, ties, values = (np.concatenate(column) for column in held)
    del held
    if us.dtype == object or ties.dtype == object:
        order = pd.DataFrame({"us": us, "tie": ties}).sort_values(["us", "tie"], kind="stable").index.to_numpy()
    else:
        order = np.lexsort((ties, us))
    for start in range(0, len(order), size):
        at = order[start : start + size]
        out, state = ewma_rows(pd.DataFrame({"us": us[at], tie: ties[at], "value": values[at]}), state, key, name, tie, alpha, k)
        yield out, state


def ewma_rows(rows: pd.DataFrame, state: tuple | None, key: str, name, tie: str, alpha: float, k: float) -> tuple[pd.DataFrame, tuple[float, float]]:
    """Rows of a feature, which are in time order, after the state: the rows with thresholds and flags, and the state after them."""
    v = rows["value"].to_numpy()
    m, s = (float(v[0]), 0.0) if state is None else state

    def smooth(first: float, values: np.ndarray) -> np.ndarray:
        return pd.Series(np.concatenate([[first], values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()

    level = smooth(m, v)
    spread = smooth(s, (1.0 - alpha) * (v - level[:-1]) ** 2)
    limit = level + k * np.sqrt(spread)
    before = limit[:-1].copy()
    if state is None:
        before[0] = np.inf
    columns = {"us": rows["us"].to_numpy(), "value": v, "ewma": level[1:], "ewmvar": spread[1:], "threshold": limit[1:], "previous_threshold": before, "is_anomaly": v > before}
    return pd.DataFrame({key: name, tie: rows[tie].to_numpy(), **columns}), (float(level[-1]), float(spread[-1]))


def ewma_stream(
    stream: DataFrame,
    key: str = "feature",
    ts: str = "ts",
    tie: str = "row_id",
    value: str = "value",
    alpha: float = 0.3,
    k: float = 3.0,
    initial: DataFrame | None = None,
    unused_seconds: float | None = None,
) -> DataFrame:
    """Thresholds and flags per feature; the state is mean and variance.

    Rows enter in arrival order of the batches, and in time order within one. ``initial`` (key, ``ewma``,
    ``ewmvar``), as ``load_threshold_state`` gives it, continues earlier series; the state of a feature
    without rows for ``unused_seconds`` is dropped, and the feature starts anew. Both need the RocksDB store.
    Spark keeps a query that drops state by the clock awake, so ``unused_seconds`` is for a query that runs on,
    not for one that is to end when there is nothing left to read.
    """
    narrow = stream.where(F.col(value).isNotNull()).select(key, tie, epoch_micros(ts).alias("us"), F.col(value).cast("double").alias("value"))
    numbers = [T.StructField(c, T.DoubleType()) for c in ("value", "ewma", "ewmvar", "threshold", "previous_threshold")]
    out = T.StructType(
        [stream.schema[key], stream.schema[tie], T.StructField("us", T.LongType()), *numbers, T.StructField("is_anomaly", T.BooleanType())]
    )
    if initial is not None or unused_seconds is not None:
        use_rocksdb(stream.sparkSession)
        unused = None if unused_seconds is None else max(int(unused_seconds * 1000), 1)
        start = None if initial is None else initial.select(key, F.col("ewma").cast("double"), F.col("ewmvar").cast("double")).groupBy(key)
        found = narrow.groupBy(key).transformWithStateInPandas(EwmaProcessor(key, tie, alpha, k, unused), out, "Append", "None" if unused is None else "ProcessingTime", initialState=start)
        return found.withColumn(ts, F.timestamp_micros("us")).drop("us")
    kept = T.StructType([T.StructField("m", T.DoubleType()), T.StructField("s", T.DoubleType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        after = state.get if state.exists else None
        for rows, after in ewma_parts(frames, after, key, group[0], tie, alpha, k):
            yield rows
        state.update(after)

    found = narrow.groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
    return found.withColumn(ts, F.timestamp_micros("us")).drop("us")


def debounce_stream(stream: DataFrame, key: str, row_id: str, seconds: float = 2.0, ts: str = "ts") -> DataFrame:
    """Kept hits per key: (key, row id, ts); the state is the last kept time."""
    gap = seconds_to_micros(seconds)
    narrow = stream.select(key, row_id, epoch_micros(ts).alias("us")).where(F.col("us").isNotNull())
    out = T.StructType([stream.schema[key], stream.schema[row_id], T.StructField("us", T.LongType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["us", row_id], kind="stable")
        us = rows["us"].to_numpy()
        i = int(np.searchsorted(us, state.get[0] + gap, "left")) if state.exists else 0
        chosen = []
        while i < len(us):
            chosen.append(i)
            i = int(np.searchsorted(us, us[i] + gap, "left"))
        if chosen:
            state.update((int(us[chosen[-1]]),))
        picked = rows.iloc[chosen]
        yield pd.DataFrame({key: group[0], row_id: picked[row_id].to_numpy(), "us": picked["us"].to_numpy()})

    kept = T.StructType([T.StructField("kept", T.LongType())])
    found = narrow.groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
    return found.select(key, row_id, F.timestamp_micros("us").alias(ts))


def _split_rules(rules: Sequence[R.SignatureRule]) -> tuple[list[tuple[int, R.SignatureRule]], list[tuple[int, R.RateRule, list]]]:
    """(place and rule of the rules without state, [(place, rate rule, rules that must pass first)])."""
    plain, stateful = [], []
    for place, rule in enumerate(rules):
        if isinstance(rule, R.RateRule):
            stateful.append((place, rule, []))
        elif isinstance(rule, R.CompositeRule) and any(isinstance(s, R.RateRule) for s in rule.subrules):
            *before, last = rule.subrules
            if rule.operator != "and" or not isinstance(last, R.RateRule) or any(isinstance(s, R.RateRule) for s in before):
                raise ValueError(f"on a stream a rate rule must come last in an 'and' rule: {rule.rule_id}")
            stateful.append((place, last, before))
        else:
            plain.append((place, rule))
    return plain, stateful


def detect_stream(stream: DataFrame, rules: Sequence[R.SignatureRule], row_id: str = "packet_id", ts: str = "ts") -> DataFrame:
    """One alert for each packet of a stream that matches a rule: the first in list order, with its envelope.

    The result is that of :func:`rules.check_signatures`, with ``timestamp``, rule fields, ``source`` and the
    ``type``, ``data`` and ``packet`` of the alert envelope. Rate rules are decided by :func:`rate_stream`;
    their hits meet the packets again on id and time. With one rate rule that is an outer join, so a packet waits for
    the watermark only if the rule does not hit it; with several, hits and packets wait for it in one step. Packets without id or time raise no alert where there are rate rules. Ids are
    taken to be unique.
    """
    plain, stateful = _split_rules(rules)
    flagged, names = R.evaluate_rules(stream, [rule for _, rule in plain], ts) if plain else (stream, [])
    first = F.coalesce(*[F.when(F.col(n), F.lit(place)) for n, (place, _) in zip(names, plain, strict=True)], F.lit(None).cast("int"))
    packets = flagged.withColumn("_plain", first).drop(*names)
    if stateful:
        use_rocksdb(stream.sparkSession)
        rates, asked = {}, set()
        for place, rate, before in stateful:
            # a rate rule that an earlier one repeats is never first
            if (rate.track_by, rate.count, rate.seconds) in asked:
                continue
            if not before:
                asked.add((rate.track_by, rate.count, rate.seconds))
            gate = reduce(and_, [F.coalesce(needed.column(), F.lit(False)) for needed in before]) if before else None
            rates[place] = (rate.track_by, rate.count, rate.seconds, gate)
        hits = _rate_hits(stream, rates, row_id, ts).select(F.col("ts").alias("_at"), F.col(row_id).alias("_of"), F.col("_rule").alias("_rate"))
        if stateful[1:]:
            # hits of several rules wait for the watermark anyway: one step gathers them together with the packets
            rows = packets.select(F.col(ts).alias("_at"), F.col(row_id).alias("_of"), F.lit(None).cast("int").alias("_rate"), F.struct(*packets.columns).alias("_row"))
            both = rows.unionByName(hits.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
            met = both.groupBy("_at", "_of").agg(F.min("_rate").alias("_rate"), F.collect_list("_row").alias("_rows"))
            met = met.select(F.when(F.col("_of").isNotNull(), F.col("_rate")).alias("_rate"), F.explode("_rows").alias("_row"))
            packets = met.select("_row.*", "_rate")
        else:
            packets = packets.join(hits, (F.col(row_id) == F.col("_of")) & (F.col(ts) == F.col("_at")), "left").drop("_of", "_at")
    else:
        packets = packets.withColumn("_rate", F.lit(None).cast("int"))
    fields = ["rule_id", "rule_name", "rule_description", "severity"]
    known = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, (r.rule_id, r.name, r.description, r.severity), strict=True)]) for r in rules])
    chosen = packets.withColumn("_first", F.least("_plain", "_rate")).where("_first IS NOT NULL").withColumn("_rule", F.element_at(known, F.col("_first") + 1))
    named = chosen.withColumns({f: F.col(f"_rule.{f}") for f in fields})
    alerts = alert_envelope(named, "signature", fields, ts, keep=[row_id])
    return alerts.select(row_id, "timestamp", *[F.col(f"data.{f}").alias(f) for f in fields], F.col("packet.src_ip").alias("source"), "type", "data", "packet")

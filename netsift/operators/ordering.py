"""Ordered work without unbounded groups.

Window functions put one whole partition key into one task. The helpers here
cut a key into slices (of time, of rows or of values) so that a key holding a
large share of the table is spread over many tasks, and still give the exact
answer: neighbouring rows are copied into the next slice, or the totals of the
earlier slices are added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
MAX_PARTS = 256
EXACT_LIMIT = 200_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only where none is set, a temporary one (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without zone)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def event_micros(df: DataFrame, ts: str) -> Column:
    """As :func:`epoch_micros`; a number is read as seconds and rounded, not cut, to microseconds."""
    if isinstance(df.schema[ts].dataType, T.IntegralType):
        # whole seconds stay whole; numbers too large to be seconds in this range give NULL, not a failed job
        return F.try_multiply(F.col(ts).cast("long"), F.lit(MICROS))
    if isinstance(df.schema[ts].dataType, T.NumericType):
        return F.round(F.col(ts).cast("double") * MICROS).cast("long")
    return epoch_micros(ts)


def seconds_to_micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def time_slices(df: DataFrame, ts: str, lookback: float, width: float | None = None) -> DataFrame:
    """Copy each row into every time slice that may look back at it.

    Adds ``_us`` (epoch microseconds), ``_slice`` and ``_own`` (true in the one
    slice the row belongs to). A row's trailing ``lookback`` seconds lie wholly
    inside its own slice, so windows may be partitioned by ``_slice`` too. With
    the default width of four look-backs a quarter of the rows is copied.
    Rows without a time stay in one slice of their own (NULL).
    """
    back = seconds_to_micros(lookback)
    wide = seconds_to_micros(width) if width else max(4 * back, MICROS)
    if wide < back:
        raise ValueError("a slice must not be shorter than the look-back")
    home = F.floor(F.col("_us") / F.lit(wide)).cast("long")
    last = F.floor((F.col("_us") + F.lit(back)) / F.lit(wide)).cast("long")
    return (
        df.withColumn("_us", event_micros(df, ts))
        .withColumn("_home", home)
        .withColumn("_slice", F.explode_outer(F.sequence(F.col("_home"), last)))
        .withColumn("_own", F.col("_slice").eqNullSafe(F.col("_home")))
        .drop("_home")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], slice_seconds: float = 3600.0, name: str = "_rn"
) -> DataFrame:
    """Row number (from 1) per key in time order, from per-slice counts.

    Only the counts per (key, slice) are scanned in order; the rows themselves
    are ranked inside their slice.
    """
    wide = seconds_to_micros(slice_seconds)
    cut = df.withColumn("_us", event_micros(df, ts)).withColumn("_cut", F.floor(F.col("_us") / F.lit(wide)))
    keys = list(keys)
    counts = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col("_cut").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)], F.col("_cut").alias("_o_cut"), "_before")
    on = F.col("_cut").eqNullSafe(F.col("_o_cut"))
    for i, k in enumerate(keys):
        on = on & cut[k].eqNullSafe(offsets[f"_o_{i}"])
    inside = Window.partitionBy(*keys, "_cut").orderBy("_us", *tie)
    return (
        cut.join(offsets, on, "left")
        .withColumn(name, F.row_number().over(inside) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_us", "_cut", "_o_cut", "_before", *[f"_o_{i}" for i in range(len(keys))])
    )


def row_chunks(df: DataFrame, lookback_rows: int, row_number: str = "_rn", size: int | None = None) -> DataFrame:
    """Cut numbered rows into chunks; each chunk also gets the rows it looks back at."""
    size = size or max(20 * lookback_rows, 1000)
    home = F.floor(F.col(row_number) / F.lit(size)).cast("long")
    last = F.floor((F.col(row_number) + F.lit(lookback_rows)) / F.lit(size)).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence("_home", last)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def value_cuts(df: DataFrame, order: str, key: str | None = None, parts: int | None = None) -> dict:
    """Cut points that split an ordered column into about equal parts, per key.

    At most ``MAX_PARTS`` numbers per key come to the driver. They are literals
    in the later plan, so a recomputed task cuts exactly as the lost one did.
    """
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, min(parts, MAX_PARTS))
    fractions = [i / parts for i in range(1, parts)]
    cuts = F.percentile_approx(F.col(order), fractions, 1000).alias("cuts")
    if key is None:
        row = df.agg(cuts).first()
        return {None: sorted(set(row["cuts"] or []))}
    return {r[key]: sorted(set(r["cuts"] or [])) for r in df.groupBy(key).agg(cuts).collect()}


def _part_of(order: str, key: str | None, cuts: dict, kind: T.DataType) -> Column:
    array_type = T.ArrayType(kind)

    def literal(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(array_type) if values else F.array().cast(array_type)

    if key is None:
        edges = literal(cuts[None])
    else:
        edges = None
        for k, values in cuts.items():
            branch = F.col(key).eqNullSafe(F.lit(k))
            edges = F.when(branch, literal(values)) if edges is None else edges.when(branch, literal(values))
        if edges is None:
            edges = literal([])
    return F.size(F.filter(edges, lambda c: c < F.col(order)))


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    key: str | None = None,
    descending: bool = False,
    next_value: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running sums over one global order (per ``key`` if given).

    ``df`` holds one row per distinct value of ``order``. ``sums`` maps new
    names to the columns to add up; the running sum includes the row itself.
    ``next_value`` names a column for the following value in the order.
    """
    cuts = value_cuts(df, order, key, parts)
    keys = [key] if key else []
    cut = df.withColumn("_part", _part_of(order, key, cuts, df.schema[order].dataType))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    edge = F.max(order) if descending else F.min(order)
    totals = cut.groupBy(*keys, "_part").agg(
        *[F.sum(src).alias(f"_t_{name}") for name, src in sums.items()], edge.alias("_edge")
    )
    by_part = Window.partitionBy(*keys).orderBy(direction("_part"))
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_o_part"),
        F.lead("_edge").over(by_part).alias("_next_edge"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    on = F.col("_part") == F.col("_o_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(direction(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # at most MAX_PARTS rows per key
    out = cut.join(F.broadcast(offsets), on, "left")
    for name, src in sums.items():
        out = out.withColumn(name, F.sum(src).over(upto) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)))
    if next_value:
        out = out.withColumn(next_value, F.coalesce(F.lead(order).over(inside), F.col("_next_edge")))
    return out.drop("_part", "_o_part", "_next_edge", *[f"_b_{n}" for n in sums], *[f"_k_{k}" for k in keys])


def carry_last(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the last non-null ``value`` at or before each row in one global order.

    The rows are dealt out by ranges of the order, and the last value of each range is carried over into the
    following ones, so no task holds more than one range. ``order`` should leave few ties.
    """
    ensure_checkpoints(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, because the cuts come from a sample and must not be drawn anew
    placed = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    last = placed.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ranges = placed.select("_part").distinct().join(last, "_part", "left")
    # one row per range of the order
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("_part").alias("_of"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn(name, F.last(value, ignorenulls=True).over(upto)).join(carried, F.col("_part") == F.col("_of"))
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_part", "_of", "_carried")


def prefix_sums(rows: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to and including each row of one global order without ties.

    As :func:`carry_last`: ranges of the order are summed by themselves, and the sums of earlier ranges are added.
    """
    ensure_checkpoints(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    # one row per range of the order
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.sum(amount).alias("_sum")).select(F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn(name, F.sum(amount).over(upto)).join(before, F.col("_part") == F.col("_of"))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_of", "_before")


def grouped_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ``median``): the exact median per key; NULL and NaN values and rows without a key are left out.

    Distinct values are counted, put into one order of (key, value) and numbered by running sums; each key's
    middle ranks then name their values. No key is one task and nothing is collected, however many keys there are.
    """
    number = F.col(value).cast("double")
    counts = df.select(F.col(key).alias("_key"), number.alias("_value")).where("_key IS NOT NULL AND _value IS NOT NULL AND NOT isnan(_value)")
    counts = counts.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(counts, ["_key", "_value"], "_n", "_upto")
    ends = ranked.groupBy("_key").agg(F.max("_upto").alias("_end"), F.sum("_n").alias("_all"))
    ends = ends.select(F.col("_key").alias("_of"), (F.col("_end") - F.col("_all")).alias("_start"), "_all")
    placed = ranked.join(ends, F.col("_key") == F.col("_of")).withColumn("_rank", F.col("_upto") - F.col("_start"))
    middle = [F.expr("(_all - 1) DIV 2"), F.expr("_all DIV 2")]
    holds = [F.when((F.col("_rank") - F.col("_n") <= m) & (m < F.col("_rank")), F.col("_value")) for m in middle]
    found = placed.groupBy("_key").agg(*[F.max(h).alias(f"_m{i}") for i, h in enumerate(holds)])
    return found.select(F.col("_key").alias(key), ((F.col("_m0") + F.col("_m1")) / 2).alias("median"))


def order_values(
    df: DataFrame, ranks: dict[str, Callable[[int], Sequence[int]]], exact_limit: int = EXACT_LIMIT
) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact order statistics of numeric columns by narrowing.

    ``ranks[c]`` gives, for a column's count of values, the wanted 0-based
    ranks. Each pass brackets the wanted ranks with an approximate percentile
    and counts the rows outside; only a bracket of at most ``exact_limit`` rows
    is sorted. Returns ``{column: (count, {rank: value})}``; NULL and NaN are
    left out.
    """

    def clean(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    names = list(ranks)
    if not names:
        return {}
    row = df.agg(*[F.count(clean(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    counts = {c: int(row[f"n{i}"]) for i, c in enumerate(names)}
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    # open bracket (low, high), rows at or below low, rows inside
    todo = {
        (c, k): (None, None, 0, counts[c])
        for c in names
        for k in set(ranks[c](counts[c]) if counts[c] else [])
    }

    def inside(c: str, low, high) -> Column:
        v = clean(c)
        cond = F.lit(True)
        if low is not None:
            cond = cond & (v > F.lit(low))
        if high is not None:
            cond = cond & (v < F.lit(high))
        return F.when(cond, v)

    while todo:
        small = {q: b for q, b in todo.items() if b[3] <= exact_limit}
        big = {q: b for q, b in todo.items() if b[3] > exact_limit}
        if small:
            brackets = sorted({(c, b[0], b[1]) for (c, _), b in small.items()}, key=str)
            index = {b: i for i, b in enumerate(brackets)}
            wanted = [
                F.element_at(F.col(f"s{index[(c, b[0], b[1])]}"), k - b[2] + 1).alias(f"v{i}")
                for i, ((c, k), b) in enumerate(small.items())
            ]
            lists = [F.array_sort(F.collect_list(inside(*b))).alias(f"s{i}") for i, b in enumerate(brackets)]
            row = df.agg(*lists).select(*wanted).first()
            for i, (c, k) in enumerate(small):
                found[c][k] = row[f"v{i}"]
        if big:
            aggs = []
            for i, ((c, k), (low, high, below, size)) in enumerate(big.items()):
                p = (k - below) / size
                near = [max(p - 0.001, 0.0), min(p + 0.001, 1.0)]
                aggs.append(F.percentile_approx(inside(c, low, high), near, 10000).alias(f"p{i}"))
            row = df.agg(*aggs).first()
            guess = {q: tuple(row[f"p{i}"]) for i, q in enumerate(big)}
            aggs = []
            for i, ((c, k), (low, high, below, size)) in enumerate(big.items()):
                v, (a, b) = inside(c, low, high), guess[(c, k)]
                aggs += [
                    F.count_if(v < F.lit(a)).alias(f"la{i}"),
                    F.count_if(v <= F.lit(a)).alias(f"ma{i}"),
                    F.count_if(v < F.lit(b)).alias(f"lb{i}"),
                    F.count_if(v <= F.lit(b)).alias(f"mb{i}"),
                ]
            row = df.agg(*aggs).first()
            todo = {}
            for i, ((c, k), (low, high, below, size)) in enumerate(big.items()):
                a, b = guess[(c, k)]
                r = k - below
                la, ma, lb, mb = (int(row[f"{x}{i}"]) for x in ("la", "ma", "lb", "mb"))
                if r < la:
                    todo[(c, k)] = (low, a, below, la)
                elif r < ma:
                    found[c][k] = a
                elif r < lb:
                    todo[(c, k)] = (a, b, below + ma, lb - ma)
                elif r < mb:
                    found[c][k] = b
                else:
                    todo[(c, k)] = (b, high, below + mb, size - mb)
        else:
            todo = {}
    return {c: (counts[c], found[c]) for c in names}


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, dict[float, float | None]]:
    """Exact, linearly interpolated quantiles of numeric columns."""

    def needed(fractions):
        def ranks(n: int) -> list[int]:
            out = []
            for f in fractions:
                low = int((n - 1) * f)
                out += [low, min(low + 1, n - 1)]
            return out

        return ranks

    got = order_values(df, {c: needed(fs) for c, fs in wanted.items()})
    result: dict[str, dict[float, float | None]] = {}
    for c, fractions in wanted.items():
        n, values = got[c]
        result[c] = {}
        for f in fractions:
            if n == 0:
                result[c][f] = None
                continue
            pos = (n - 1) * f
            low = int(pos)
            a, b = values[low], values[min(low + 1, n - 1)]
            result[c][f] = a + (b - a) * (pos - low)
    return result


def time_cuts(df: DataFrame, ts: str, slice_seconds: float) -> DataFrame:
    """Add ``_us`` and the time slice ``_cut`` of each row."""
    wide = seconds_to_micros(slice_seconds)
    return df.withColumn("_us", event_micros(df, ts)).withColumn("_cut", F.floor(F.col("_us") / F.lit(wide)).cast("long"))


def sliced_scan(
    cut: DataFrame,
    keys: Sequence[str],
    tie: Sequence[str],
    summarise: Callable[[int, pd.DataFrame], pd.DataFrame],
    summary_schema: str,
    fold: Callable[..., pd.DataFrame],
    state_schema: str,
    apply: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    out_schema: T.StructType,
    compose: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    fan: int = 16,
) -> DataFrame:
    """A sequential recurrence per key, run as three parallel passes over slices.

    1. ``summarise(slice, rows)`` describes what one slice does to any entry state;
    2. ``fold`` walks slice summaries (no rows) and gives each slice its entry state;
    3. ``apply(rows, state)`` runs the recurrence inside the slice from that state.
    A key is thus never one task, only its list of slice summaries is. With ``compose``,
    which describes a run of slices as one, not even that: summaries are composed in a tree,
    ``fan`` at a time, and ``fold(parts, entry)`` hands entry states down it. ``cut``
    has ``_us`` and ``_cut`` (see :func:`time_cuts`); rows reach the functions
    sorted by ``_us`` and the tie columns.
    """
    keys, order = list(keys), ["_us", *tie]
    key_fields = ", ".join([*(f"{k} {cut.schema[k].dataType.simpleString()}" for k in keys), "_cut long"])

    def labelled(part: pd.DataFrame, names: Sequence[str], key: tuple) -> pd.DataFrame:
        for i, k in enumerate(names):
            part[k] = [key[i]] * len(part)
        return part

    def first_pass(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return labelled(summarise(key[-1], rows.sort_values(order, kind="stable").reset_index(drop=True)), [*keys, "_cut"], key)

    def second_pass(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return labelled(fold(rows.sort_values("_cut", kind="stable").reset_index(drop=True)), keys, key)

    def up_pass(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return labelled(compose(rows.sort_values("_cut", kind="stable").reset_index(drop=True)), [*keys, "_cut"], key)

    def down_pass(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return labelled(fold(rows.sort_values("_cut", kind="stable").reset_index(drop=True), entry.iloc[0]), keys, key)

    def third_pass(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=out_schema.fieldNames())
        return apply(rows.sort_values(order, kind="stable").reset_index(drop=True), state)[out_schema.fieldNames()]

    summaries = cut.groupBy(*keys, "_cut").applyInPandas(first_pass, f"{key_fields}, {summary_schema}")
    if compose is None:
        states = summaries.groupBy(*keys).applyInPandas(second_pass, f"{key_fields}, {state_schema}")
    else:
        ensure_checkpoints(cut.sparkSession)
        levels = [summaries.checkpoint()]
        low, high = levels[0].agg(F.min("_cut"), F.max("_cut")).first()
        up = F.floor(F.col("_cut") / F.lit(fan)).cast("long")
        width = 1 if low is None else high // fan - low // fan + 1
        while width > 1:
            level = levels[-1].withColumn("_up", up).groupBy(*keys, "_up").applyInPandas(up_pass, f"{key_fields}, {summary_schema}")
            levels.append(level.checkpoint())
            low, high = low // fan, high // fan
            width = high // fan - low // fan + 1
        states = levels[-1].groupBy(*keys).applyInPandas(second_pass, f"{key_fields}, {state_schema}")
        for level in levels[-2::-1]:
            parts, entries = level.withColumn("_up", up).groupBy(*keys, "_up"), states.groupBy(*keys, "_cut")
            states = parts.cogroup(entries).applyInPandas(down_pass, f"{key_fields}, {state_schema}")
    return (
        cut.groupBy(*keys, "_cut")
        .cogroup(states.groupBy(*keys, "_cut"))
        .applyInPandas(third_pass, out_schema)
    )

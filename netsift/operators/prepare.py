"""Cleaning and feature preparation. Fitted parameters are scalars or small tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.network import ip_value
from netsift.operators.ordering import ensure_checkpoints, quantiles, running_totals

_NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating point columns."""
    missing = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def missing_report(df: DataFrame) -> DataFrame:
    """One row per column: missing values and rows. One pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns]
    return counts.select(F.explode(F.array(*entries)).alias("e"), "_rows").select("e.*", F.col("_rows").alias("rows"))


def medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, float]:
    """Median per column: exact by narrowing, or from a sketch with ``approx``."""
    if approx:
        row = df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in cols]).first() if cols else None
        found = {c: row[c] for c in cols}
    else:
        found = {c: q[0.5] for c, q in quantiles(df, {c: [0.5] for c in cols}).items()}
    return {c: float(v) for c, v in found.items() if v is not None}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column, ties to the smallest; values are counted before they are compared."""
    if not cols:
        return {}
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("x"))
    counts = cells.where(F.col("x.v").isNotNull()).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    # the smallest of the most frequent: greatest count first, then the least text
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("b"))
    return {r["c"]: r["b"]["v"] for r in best.collect()}


def _fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill missing cells; an integer column becomes a double if its value is not whole."""
    out = {}
    for c, v in values.items():
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType) and isinstance(v, float) and v != int(v):
            kind = T.DoubleType()
        out[c] = F.when(is_missing(df, c), F.lit(v).cast(kind)).otherwise(F.col(c).cast(kind))
    return df.withColumns(out) if out else df


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    return _fill(df, medians(df, numeric_columns(df) if cols is None else cols, approx))


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, modes(df, text_columns(df) if cols is None else cols))


def dedupe(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Drop duplicate rows; with ``order_by`` that column is not compared and its least value is kept."""
    if order_by is None:
        return df.dropDuplicates()
    same = [c for c in df.columns if c != order_by]
    return df.groupBy(*same).agg(F.min(order_by).alias(order_by)).select(*df.columns)


def factor_codes(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Table (value, code): values numbered from 0 by first appearance."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order_by).alias("_first"))
    ranked = running_totals(first.withColumn("_one", F.lit(1)), "_first", {"_rank": "_one"})
    return ranked.select("value", (F.col("_rank") - 1).cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace a text column by its code; NULL and unknown values give -1."""
    codes = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(codes, F.col(column) == F.col("_value"), "left")
    return joined.select(*[F.coalesce("_code", F.lit(-1)).alias(column) if c == column else F.col(c) for c in df.columns])


def factorize(df: DataFrame, cols: Sequence[str], order_by: str) -> DataFrame:
    """Codes by first appearance in ``order_by``; NULL is -1."""
    out = df
    for c in cols:
        out = encode(out, c, factor_codes(df, c, order_by))
    return out


def split_label(df: DataFrame, label: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Features (without the label) and (row id, label)."""
    return df.drop(label), df.select(row_id, label)


def scale_constants(df: DataFrame, cols: Sequence[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column in one pass; constant columns divide by 1."""
    if not cols:
        return {}
    if method == "standard":
        aggs = [(F.avg(c), F.stddev_pop(c)) for c in cols]
    elif method == "minmax":
        aggs = [(F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")) for c in cols]
    else:
        raise ValueError(f"unknown scaling: {method}")
    row = df.agg(*[x.alias(f"{k}{i}") for i, pair in enumerate(aggs) for k, x in zip("ab", pair, strict=True)]).first()
    return {c: (row[f"a{i}"] or 0.0, row[f"b{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, constants: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(shift)) / F.lit(float(div)) for c, (shift, div) in constants.items()})


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation."""
    return scale(df, scale_constants(df, cols, "standard"))


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range 0..1; a constant column becomes 0."""
    return scale(df, scale_constants(df, cols, "minmax"))


@dataclass
class FittedPreprocessor:
    """Parameters of a fitted pipeline; ``codes`` are tables."""

    label: str | None
    order_by: str
    medians: dict[str, float]
    modes: dict[str, str]
    codes: dict[str, DataFrame]
    constants: dict[str, tuple[float, float]] = field(default_factory=dict)

    def clean(self, df: DataFrame) -> DataFrame:
        return _fill(_fill(df, self.medians), self.modes)

    def encode(self, df: DataFrame) -> DataFrame:
        for c, codes in self.codes.items():
            df = encode(df, c, codes)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return scale(self.encode(self.clean(df)), self.constants)

    def save(self, path: str) -> None:
        spark = next(iter(self.codes.values())).sparkSession if self.codes else SparkSession.getActiveSession()
        numbers = {
            "label": self.label,
            "order_by": self.order_by,
            "medians": self.medians,
            "modes": self.modes,
            "constants": self.constants,
            "codes": list(self.codes),
        }
        spark.createDataFrame([(json.dumps(numbers),)], "parameters string").write.mode("overwrite").parquet(f"{path}/parameters")
        for c, codes in self.codes.items():
            codes.write.mode("overwrite").parquet(f"{path}/codes/{c}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPreprocessor:
        p = json.loads(spark.read.parquet(f"{path}/parameters").first()["parameters"])
        codes = {c: spark.read.parquet(f"{path}/codes/{c}") for c in p["codes"]}
        constants = {c: tuple(v) for c, v in p["constants"].items()}
        return FittedPreprocessor(p["label"], p["order_by"], p["medians"], p["modes"], codes, constants)


@dataclass
class Preprocessor:
    """Impute, drop duplicates, encode, scale; ``order_by`` numbers the rows."""

    order_by: str
    label: str | None = None
    method: str = "standard"

    def fit_transform(self, df: DataFrame) -> tuple[FittedPreprocessor, DataFrame]:
        fixed = {self.order_by}
        numbers = [c for c in numeric_columns(df) if c not in fixed]
        texts = [c for c in text_columns(df) if c not in fixed]
        fitted = FittedPreprocessor(self.label, self.order_by, medians(df, numbers), modes(df, texts), {})
        cleaned = fitted.clean(df)
        # the first of equal rows stays, so first appearances are the same before duplicates are dropped
        fitted.codes = {c: factor_codes(cleaned, c, self.order_by) for c in texts}
        ensure_checkpoints(df.sparkSession)
        encoded = fitted.encode(dedupe(cleaned, self.order_by)).checkpoint()
        features = [c for c in [*numbers, *texts] if c != self.label]
        fitted.constants = scale_constants(encoded, features, self.method)
        return fitted, scale(encoded, fitted.constants)

    def fit(self, df: DataFrame) -> FittedPreprocessor:
        return self.fit_transform(df)[0]


def prepare_flows(flows: DataFrame, protocols: Sequence[str] = ("TCP", "UDP", "ICMP")) -> DataFrame:
    """Flow rows for a model: addresses as numbers, one column per protocol, missing values 0."""
    out = flows
    for c in ("src_ip", "dst_ip"):
        if c in out.columns:
            out = out.withColumn(f"{c}_numeric", ip_value(c)).drop(c)
    if "protocol" in out.columns:
        one_hot = {f"protocol_{p}": F.coalesce((F.col("protocol") == p).cast("int"), F.lit(0)) for p in protocols}
        out = out.withColumns(one_hot).drop("protocol")
    return out.fillna(0)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing; for numbers mean, deviation (n-1), minimum, quartiles, maximum."""
    numbers = numeric_columns(df)
    quarters = quantiles(df, {c: [0.25, 0.5, 0.75] for c in numbers})
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"m{i}"))
        if c in numbers:
            x = F.when(~is_missing(df, c), F.col(c).cast("double"))
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    none = F.lit(None).cast("double")
    entries = []
    for i, (c, f) in enumerate(zip(df.columns, df.schema.fields, strict=True)):
        is_number = c in numbers
        q = quarters.get(c, {})
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"m{i}").alias("missing"),
                *[(F.col(f"{k}{i}") if is_number else none).alias(n) for k, n in zip("asl", ("mean", "std", "min"), strict=True)],
                *[F.lit(q.get(x)).cast("double").alias(n) for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))],
                (F.col(f"h{i}") if is_number else none).alias("max"),
            )
        )
    return df.agg(*aggs).select(F.col("_rows").alias("rows"), F.explode(F.array(*entries)).alias("e")).select("e.*", "rows")

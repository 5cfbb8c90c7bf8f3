"""Plate detections: de-bouncing, frame sampling, candidates, overlap suppression, voting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.plates import clean_plate
from netsift.operators.ordering import ensure_checkpoints, seconds_to_micros, sliced_scan, time_cuts

NO_PLATE = "No valid license plate detected"
NMS_ROUND = 1000
GROUP_ROWS = 100_000


def debounce(
    df: DataFrame,
    key: str,
    ts: str,
    seconds: float = 2.0,
    tie: str | None = None,
    suppress_start: bool = False,
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Keep a hit, then drop hits until ``seconds`` after the last kept one.

    ``suppress_start`` counts time 0 as kept, which drops the hits of the first
    seconds. A slice's effect depends only on its first kept hit, so it is
    described by the few hits that can be first.
    """
    gap = seconds_to_micros(seconds)
    ties = [tie] if tie else []
    fields = list(df.schema.fields)
    cut = time_cuts(df.where(F.col(ts).isNotNull()), ts, slice_seconds)

    def summarise(_: int, rows: pd.DataFrame) -> pd.DataFrame:
        us = rows["_us"].to_numpy()
        after = np.searchsorted(us, us + gap, "left")
        last = np.arange(len(us))
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                last[i] = last[after[i]]
        # hits from which the slice can start: those before its first hit plus the gap, and the next one
        first = np.arange(min(int(after[0]) + 1, len(us)))
        table = pd.DataFrame({"from_us": us[first], "last_us": us[last[first]]})
        # of neighbouring starts with the same end the latest is enough: an earlier need finds it
        return table[table["last_us"] != table["last_us"].shift(-1)]

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        kept = 0 if suppress_start else None
        out = []
        for slice_no, steps in parts.groupby("_cut", sort=True):
            out.append((slice_no, kept))
            need = None if kept is None else kept + gap
            steps = steps.sort_values("from_us")
            possible = steps if need is None else steps[steps["from_us"] >= need]
            if len(possible):
                kept = int(possible["last_us"].iloc[0])
        return pd.DataFrame({"_cut": [c for c, _ in out], "kept_us": pd.array([k for _, k in out], dtype="Int64")})

    def apply(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        us = rows["_us"].to_numpy()
        kept = state["kept_us"].iloc[0] if len(state) else None
        i = 0 if kept is None or pd.isna(kept) else int(np.searchsorted(us, int(kept) + gap, "left"))
        chosen = []
        while i < len(us):
            chosen.append(i)
            i = int(np.searchsorted(us, us[i] + gap, "left"))
        return rows.iloc[chosen]

    return sliced_scan(
        cut, [key], ties, summarise, "from_us long, last_us long", fold, "kept_us long", apply, T.StructType(fields)
    )


def sample_frames(df: DataFrame, n: int = 5, frame: str = "frame") -> DataFrame:
    """Frame 1 and every n-th frame."""
    return df.where((F.col(frame) % n == 0) | (F.col(frame) == 1))


def plate_candidates(df: DataFrame, image: str = "image", top: int = 10, tie: Sequence[str] = ("x", "y", "w", "h")) -> DataFrame:
    """Of the ten largest regions of an image, those shaped like a plate."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.col("area").desc(), *tie))
    ratio = F.col("w") / F.col("h").cast("double")
    largest = df.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    return largest.where((F.col("h") > 20) & (F.col("w") > 100) & (ratio > 2.0) & (ratio < 6.0))


def _greedy(rows: pd.DataFrame, iou: float) -> pd.DataFrame:
    """Keep boxes by falling confidence unless they overlap a kept one."""
    rows = rows.sort_values("_rank").reset_index(drop=True)
    x, y, w, h = (rows[c].to_numpy(dtype=float) for c in "xywh")
    kept = np.zeros(len(rows), dtype=bool)
    left = np.arange(len(rows))
    while len(left):
        i, rest = left[0], left[1:]
        kept[i] = True
        width = np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest])
        height = np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest])
        both = np.clip(width, 0, None) * np.clip(height, 0, None)
        union = w[i] * h[i] + w[rest] * h[rest] - both
        left = rest[np.divide(both, union, out=np.zeros_like(both), where=union > 0) <= iou]
    rows["_kept"] = kept
    return rows


def _not_covered(rest: DataFrame, kept: DataFrame, iou: float, image: str, box_id: str) -> DataFrame:
    """Rows of ``rest`` that overlap no kept box of their image; a large image is split over several tasks."""
    parts = rest.groupBy(F.col(image).alias("_image")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_parts"))
    on = F.col(image) == F.col("_image")
    left = rest.join(parts, on).withColumn("_part", F.pmod(F.xxhash64(box_id), F.col("_parts")).cast("int"))
    right = kept.join(parts, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = right.select(image, "_part", "x", "y", "w", "h")
    fields = rest.schema.fieldNames()

    def uncovered(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        covered = np.zeros(len(rows), dtype=bool)
        x, y, w, h = (rows[c].to_numpy(dtype=float) for c in "xywh")
        for k in others[["x", "y", "w", "h"]].to_numpy(dtype=float):
            width = np.minimum(x + w, k[0] + k[2]) - np.maximum(x, k[0])
            height = np.minimum(y + h, k[1] + k[3]) - np.maximum(y, k[1])
            both = np.clip(width, 0, None) * np.clip(height, 0, None)
            union = w * h + k[2] * k[3] - both
            covered |= np.divide(both, union, out=np.zeros_like(both), where=union > 0) > iou
        return rows.loc[~covered, fields]

    keys = [image, "_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(uncovered, rest.schema)


def nms(
    boxes: DataFrame,
    iou: float = 0.4,
    image: str = "image",
    box_id: str = "box_id",
    confidence: str = "confidence",
    min_confidence: float | None = None,
    wanted_class: str | None = None,
    round_size: int = NMS_ROUND,
) -> DataFrame:
    """Non-maximum suppression per image over all classes, then the class filter.

    Each round decides an image's best ``round_size`` boxes and drops the rest
    that overlap the kept ones, so an image with many boxes is never one task;
    ordinary images are done after the first round.
    """
    if min_confidence is not None:
        boxes = boxes.where(F.col(confidence) > min_confidence)
    ensure_checkpoints(boxes.sparkSession)
    order = Window.partitionBy(image).orderBy(F.col(confidence).desc(), box_id)
    schema = T.StructType([*boxes.schema.fields, T.StructField("_rank", T.IntegerType()), T.StructField("_kept", T.BooleanType())])
    columns = schema.fieldNames()
    left, result = boxes, None
    while True:
        best = left.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= round_size)
        decided = best.groupBy(image).applyInPandas(lambda rows: _greedy(rows, iou)[columns], schema).checkpoint()
        kept = decided.where("_kept").drop("_rank", "_kept")
        result = kept if result is None else result.unionByName(kept)
        # images with further boxes, and where this round ended in them
        place = F.struct((-F.col(confidence)).alias("c"), F.col(box_id).alias("i"))
        full = decided.groupBy(F.col(image).alias("_image")).agg(F.count(F.lit(1)).alias("_n"), F.max(place).alias("_end"))
        full = full.where(F.col("_n") == round_size)
        if full.isEmpty():
            break
        rest = left.join(full, F.col(image) == F.col("_image")).where(place > F.col("_end")).select(*boxes.columns)
        left = _not_covered(rest, kept, iou, image, box_id).checkpoint()
    return result if wanted_class is None else result.where(F.col("class") == wanted_class)


def vote_plate(readings: DataFrame, key: str, order: str, text: str = "raw_text") -> DataFrame:
    """The most common valid text per key, ties to the first seen; else a message."""
    cleaned = readings.select(key, order, clean_plate(text).alias("_p"))
    counts = cleaned.groupBy(key, F.when(F.col("_p.valid"), F.col("_p.text")).alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    rank = F.struct((-F.col("n")).alias("n"), F.col("first").alias("first"), F.col("text").alias("text"))
    best = counts.groupBy(key).agg(F.min(F.when(F.col("text").isNotNull(), rank)).alias("_b"))
    return best.select(key, F.coalesce("_b.text", F.lit(NO_PLATE)).alias("plate"), F.coalesce(-F.col("_b.n"), F.lit(0)).alias("votes"))


def first_valid_plate(readings: DataFrame, key: str, order: str, text: str = "raw_text") -> DataFrame:
    """The first valid text per key; else a message."""
    cleaned = readings.select(key, order, clean_plate(text).alias("_p"))
    first = F.min(F.when(F.col("_p.valid"), F.struct(F.col(order).alias("o"), F.col("_p.text").alias("t"))))
    return cleaned.groupBy(key).agg(first.alias("_f")).select(key, F.coalesce("_f.t", F.lit(NO_PLATE)).alias("plate"))

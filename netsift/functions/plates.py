"""Plate texts and detector boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.network import _col

PLATE_LENGTH = (4, 10)


def clean_plate(text: str | Column) -> Column:
    """Struct(text, valid): capitals and digits only, valid when 4 to 10 long."""
    cleaned = F.regexp_replace(F.upper(_col(text)), "[^A-Z0-9]", "")
    return F.struct(cleaned.alias("text"), F.length(cleaned).between(*PLATE_LENGTH).alias("valid"))


def decode_boxes(
    df: DataFrame,
    classes: Sequence[str],
    threshold: float = 0.5,
    scores: str = "scores",
    width: str = "image_width",
    height: str = "image_height",
) -> DataFrame:
    """Detector output rows to pixel boxes.

    Needs relative ``cx``, ``cy``, ``bw``, ``bh``, the class ``scores`` and the
    image size. Keeps rows whose best class scores above ``threshold``.
    """
    best = F.array_max(scores)
    class_id = (F.array_position(scores, best) - 1).cast("int")
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.col("class_id"))
    w = (F.col("bw") * F.col(width)).cast("int")
    h = (F.col("bh") * F.col(height)).cast("int")
    x = ((F.col("cx") * F.col(width)).cast("int") - w / 2).cast("int")
    y = ((F.col("cy") * F.col(height)).cast("int") - h / 2).cast("int")
    rest = [c for c in df.columns if c not in {"cx", "cy", "bw", "bh", scores}]
    return (
        df.withColumn("confidence", best)
        .where(F.col("confidence") > threshold)
        .withColumn("class_id", class_id)
        .select(
            *rest, x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "confidence", "class_id", name.alias("class")
        )
    )


def clip_boxes(df: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Boxes cut to the image: the corner moves inside, the size ends at the far border."""
    x, y = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    w, h = F.least(F.col("w"), F.col(width) - x), F.least(F.col("h"), F.col(height) - y)
    return df.withColumns({"x": x, "y": y, "w": w, "h": h})

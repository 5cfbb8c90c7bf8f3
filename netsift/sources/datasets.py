"""Tables by file extension, and image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp"]


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (with header) or parquet, by extension; anything else is an error.

    Without a ``schema`` the types of a CSV file are inferred, which reads it once more.
    """
    lower = path.lower()
    if lower.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    if lower.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def scan_images(spark: SparkSession, directory: str) -> DataFrame:
    """One row per image file of a folder: path, name, size; contents are read only if selected."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, "[.]"), -1))
    return (
        spark.read.format("binaryFile")
        .load(directory)
        .where(name.contains(".") & extension.isin(IMAGE_EXTENSIONS))
        .select("path", name.alias("file_name"), "modificationTime", "length", "content")
    )

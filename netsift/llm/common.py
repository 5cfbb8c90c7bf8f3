"""Small pieces that the corpus operators share."""

from __future__ import annotations

import gc
import os
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = str.maketrans(UPPER, LOWER)
#: Arrow batches to Python workers are cut at this size, so that long texts do not meet in one batch
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may go without one and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bound_batches(df: DataFrame) -> DataFrame:
    """The same table; where the session sets no bound on the bytes of an Arrow batch, it gets one."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(2**31 - 1)).rstrip("bB")) >= 2**31 - 1:
        conf.set(name, str(BATCH_BYTES))
    return df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    bound_batches(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(text: str | Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose label is never learnt: crc32 of the id as text, modulo 5, is 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of the key; the same rows in every run."""
    n = bound_batches(df).count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels 0 and 1 of at most about ``per_class`` labelled rows of each class.

    Rows are chosen by their ids in the label table alone; the texts of the few that are chosen are then
    looked up, so no text is shuffled.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).where("_id IS NOT NULL")
    parts = [bounded_sample(own.where(F.col("_label") == c), "_id", per_class) for c in (0, 1)]
    # at most about twice ``per_class`` ids
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)).join(chosen, F.col(id_col) == F.col("_id"))
    return found.select(id_col, text_col, F.col("_label").alias(label))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels 0 and 1 of all labelled rows. Both sides are shuffled at any size, since both grow."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)").hint("merge")
    found = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)).join(own, F.col(id_col) == F.col("_id"))
    return found.select(id_col, text_col, F.col("_label").alias(label))


def slices(frames: Iterator[pd.DataFrame], text: str, chars: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches at about ``chars`` characters, so that work arrays stay small."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = np.fromiter((len(t) if t else 0 for t in frame[text]), dtype=np.int64, count=len(frame)).cumsum()
        part = (sizes - 1).clip(min=0) // chars
        for _, piece in frame.groupby(part, sort=True):
            yield piece.reset_index(drop=True)


def share_model(spark: SparkSession, model) -> Callable:
    """Broadcast a model by value, so that workers need no copy of the package; the function gives it back in a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(packed.value)


SUM_BLOCK = 4096


def sum_over_tasks(df: DataFrame, of_task: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum of one array of ``size`` numbers from each task; it is added up block by block on the executors."""

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = of_task(frames)
        if total is not None:
            at = range(0, size, SUM_BLOCK)
            yield pd.DataFrame({"block": np.array(at, dtype=np.int32), "sums": [total[i : i + SUM_BLOCK] for i in at]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, sums in zip(frame["block"], frame["sums"], strict=True):
                held[block] = held.get(block, 0) + np.asarray(sums, dtype=np.float64)
        if held:
            yield pd.DataFrame({"block": list(held), "sums": list(held.values())})

    schema = "block int, sums array<double>"
    blocks = bound_batches(df).mapInPandas(give, schema).repartition("block").mapInPandas(add, schema).toPandas()
    out = np.zeros(size)
    for block, sums in zip(blocks["block"], blocks["sums"], strict=True):
        out[block : block + SUM_BLOCK] = sums
    return out


def free_name(columns: Iterable[str], name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def score(docs: DataFrame, model, text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """The chosen columns of every row with the ``score`` of its whole text."""
    load = share_model(docs.sparkSession, model)
    kept = [c for c in (columns or docs.columns) if c != "score"]
    text = free_name(kept, "_text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        for frame in slices(frames, text):
            yield frame[kept].assign(score=own.scores(frame[text].tolist()))

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return bound_batches(docs).select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(text)).mapInPandas(run, f"{fields}, score double")

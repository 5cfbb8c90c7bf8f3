"""Active learning on scored rows: confident and uncertain rows, labels, balanced samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.operators.ordering import order_values, row_numbers

#: rows of a task, about, that are clustered
CLUSTER_ROWS = 100_000


def uncertainty_band(df: DataFrame, score: str, confidence: float = 0.9, uncertainty: float = 10.0) -> tuple[float, float] | None:
    """Scores around the expected decision boundary: two order statistics.

    The centre is rank ``int(n * 100 * (1 - confidence) / 100)``; the band
    reaches ``int(n * uncertainty / 2 / 100)`` ranks to both sides.
    """

    def ends(n: int) -> list[int]:
        centre = int(n * (100 * (1 - confidence)) / 100)
        reach = int(n * uncertainty / 2 / 100)
        return [max(0, centre - reach), min(n - 1, centre + reach)]

    n, values = order_values(df, {score: ends})[score]
    if n == 0:
        return None
    low, high = ends(n)
    return values[low], values[high]


def mark_uncertain(df: DataFrame, score: str, confidence: float = 0.9, uncertainty: float = 10.0) -> DataFrame:
    band = uncertainty_band(df, score, confidence, uncertainty)
    inside = F.col(score).between(F.lit(band[0]), F.lit(band[1])) if band else F.lit(False)
    return df.withColumn("is_uncertain", F.coalesce(inside, F.lit(False)))


def split_confident(df: DataFrame, score: str, confidence: float = 0.9, uncertainty: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(confident, uncertain) rows; the band's ends are uncertain."""
    marked = mark_uncertain(df, score, confidence, uncertainty)
    return marked.where(~F.col("is_uncertain")), marked.where("is_uncertain")


def apply_labels(uncertain: DataFrame, labels: DataFrame, row_id: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(newly labelled, still uncertain) after manual labels (``row_id``, ``label``)."""
    given = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("boolean").alias("_label"))
    joined = uncertain.join(given, F.col(row_id) == F.col("_id"))
    labelled = joined.withColumns({"is_anomaly": F.col("_label"), "is_uncertain": F.lit(False)}).drop("_id", "_label")
    return labelled.select(*uncertain.columns), uncertain.join(given, F.col(row_id) == F.col("_id"), "left_anti")


def keep_latest(df: DataFrame, order: str, n: int, keys: Sequence[str] = (), tie: str | None = None, slice_seconds: float = 3600.0) -> DataFrame:
    """The latest ``n`` rows, of the table or of each key.

    Per key the rows are ranked from the end by time slices, so a key is never
    one task.
    """
    ties = [tie] if tie else []
    if not keys:
        return df.orderBy(F.col(order).desc(), *[F.col(t).desc() for t in ties]).limit(n)
    numbered = row_numbers(df, keys, order, ties, slice_seconds, "_rn")
    counts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return numbered.join(counts, on).where(F.col("_rn") > F.col("_n") - n).select(*df.columns)


def update_pools(
    labelled: DataFrame, uncertain: DataFrame, confident: DataFrame, doubtful: DataFrame, newly: DataFrame, row_id: str, order: str, max_samples: int
) -> tuple[DataFrame, DataFrame]:
    """New (labelled, uncertain) pools: rows added, labelled ones moved, both cut to the latest."""
    known = newly.select(F.col(row_id).alias("_id"))
    pool = labelled.unionByName(confident).unionByName(newly.select(*labelled.columns))
    waiting = uncertain.unionByName(doubtful).join(known, F.col(row_id) == F.col("_id"), "left_anti")
    return keep_latest(pool, order, 10 * max_samples, tie=row_id), keep_latest(waiting, order, max_samples, tie=row_id)


def balanced_sample(
    df: DataFrame, label: str, row_id: str, seed: int = 42, min_per_class: int = 50, max_rows: int | None = None
) -> DataFrame:
    """As many rows of each class, chosen by a seeded hash; empty when a class is too small.

    The class's rows are not sorted: the hash below which enough rows lie is
    found first, as an order statistic.
    """
    rank = F.xxhash64(F.lit(seed), F.col(row_id)).cast("double")
    flag = F.col(label).cast("boolean")
    marked = df.withColumn("_h", rank)
    split = marked.select(F.when(flag, F.col("_h")).alias("a"), F.when(~flag, F.col("_h")).alias("n"))
    counts = split.agg(F.count("a").alias("a"), F.count("n").alias("n")).first()
    if min(counts["a"], counts["n"]) < min_per_class:
        return df.where(F.lit(False))
    size = min(counts["a"], counts["n"])
    if max_rows and max_rows > 0:
        size = min(size, max_rows // 2)
    if size == 0:
        return df.where(F.lit(False))
    cut = order_values(split, {c: (lambda n: [size - 1]) for c in ("a", "n")})
    high = F.when(flag, F.lit(cut["a"][1][size - 1])).otherwise(F.lit(cut["n"][1][size - 1]))
    return marked.where(flag.isNotNull() & (F.col("_h") <= high)).drop("_h")


def labelling_metrics(df: DataFrame, is_anomaly: str = "is_anomaly", is_uncertain: str = "is_uncertain") -> DataFrame:
    """One row of counters over processed rows."""
    sure = ~F.col(is_uncertain)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_samples_processed"),
        F.count_if(sure & ~F.col(is_anomaly)).alias("auto_labeled_normal"),
        F.count_if(sure & F.col(is_anomaly)).alias("auto_labeled_anomaly"),
        F.count_if(F.col(is_uncertain)).alias("uncertain_samples"),
    )
    labelled = F.col("auto_labeled_normal") + F.col("auto_labeled_anomaly")
    return counts.select(
        "*",
        labelled.alias("total_labeled"),
        F.when(F.col("total_samples_processed") > 0, labelled / F.col("total_samples_processed")).otherwise(0.0).alias("labeling_rate"),
        F.when(F.col("auto_labeled_normal") > 0, F.col("auto_labeled_anomaly") / F.col("auto_labeled_normal"))
        .otherwise(F.lit(float("inf")))
        .alias("normal_anomaly_ratio"),
    )


def refine_uncertain(
    uncertain: DataFrame, features: Sequence[str], score: str, row_id: str, min_samples_per_class: int = 50, seed: int = 42
) -> DataFrame:
    """Label uncertain rows by clusters; empty unless there are more than twice ``min_samples_per_class``.

    The number of clusters (2..10) is the one with the best silhouette among
    those without a cluster below five rows. A cluster is anomalous when its
    mean score is below the median of the cluster means. Rows with a missing
    feature stay as they are: uncertain, and without a cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    schema = T.StructType([*uncertain.schema.fields, T.StructField("cluster", T.IntegerType())])
    n = uncertain.count()
    if n <= 2 * min_samples_per_class:
        return uncertain.sparkSession.createDataFrame([], schema)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    rest = uncertain.where(~whole).withColumn("cluster", F.lit(None).cast("int"))
    points = VectorAssembler(inputCols=list(features), outputCol="_x").transform(uncertain.where(whole))
    if n > CLUSTER_ROWS:
        # the rows are passed over some hundred times; a small file of many rows would be few tasks
        points = points.repartition(-(-n // CLUSTER_ROWS), row_id)
    points = points.persist()
    best, best_score, top, models = 2, -1.0, min(10, n // 10), {}
    if top < 2:
        clustered = uncertain.where(whole).withColumn("cluster", F.lit(0))
    else:
        for k in range(2, top + 1):
            models[k] = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(points)
            found = models[k].transform(points)
            sizes = [r["count"] for r in found.groupBy("cluster").count().collect()]
            if len(sizes) < k or min(sizes) < 5:
                continue
            quality = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(found)
            if quality > best_score:
                best, best_score = k, quality
        clustered = models[best].transform(points).drop("_x")
    means = {r["cluster"]: r["m"] for r in clustered.groupBy("cluster").agg(F.avg(score).alias("m")).collect()}  # at most ten
    points.unpersist()
    ordered = sorted(m for m in means.values() if m is not None)
    if not ordered:
        return clustered.unionByName(rest).select(*uncertain.columns, "cluster")
    middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    low = [c for c, m in means.items() if m is not None and m < middle]
    flag: Column = F.col("cluster").isin(low) if low else F.lit(False)
    decided = clustered.withColumns({"is_anomaly": flag, "is_uncertain": F.lit(False)})
    return decided.unionByName(rest).select(*uncertain.columns, "cluster")

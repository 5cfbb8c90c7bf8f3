"""Benchmark decontamination as a prefix-filtered containment join, with DataFrame functions only.

Every window of ``window`` consecutive words of a benchmark item (a shorter item
is one window) is a set of word shingles. A document that contains the window
contains all of its shingles, so one necessary token per window is enough to
find every candidate: the prefix of the window's shingles, ordered by rarity in
the corpus, has length one for full containment.

1. All shingles of the benchmark are looked up in the documents' shingles; this
   is the only pass over all shingles of the corpus. The hits
   ``(document, position, shingle)`` give the corpus frequencies.
2. Each window is indexed by its rarest shingle and that shingle's offset.
3. Hits on prefix shingles give candidate starts ``position - offset``, kept
   within the positional bound ``start >= 0`` and the length bound
   ``start + length <= words of the document``.
4. The words at the candidate's place are compared with the window's.

The benchmark side is broadcast only if its measured number of rows is small;
else both sides are shuffled by shingle.

Edge cases: null texts have no words; items without an id or without words are
left out; repeated items and repeated documents are each answered (equal rows
get equal answers); empty tables give no hits or no rows. Ids stay as they are;
other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import LOWER, UPPER, stage

#: 16-byte keys: this many benchmark rows are at most some tens of megabytes
BROADCAST_ROWS = 500_000
SHINGLE = 3

# every ASCII character that is neither a digit nor a letter separates words
_SEPARATORS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())


def words(text: str | Column) -> Column:
    """Maximal runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased; no words for null."""
    plain = F.translate(F.translate(text, "\x00", " "), UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def shingle_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of the ``n`` words from each position on; fewer words than that give none."""
    places = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    some = F.transform(places, lambda i: F.xxhash64(*[F.get(tokens, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(window_id, length, words)`` and their items: ``(item, window_id, length, words)``."""
    items = benchmark.select(F.col(id_col).alias("item"), words(text_col).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (
        items.select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
        .select("item", F.sha2(F.concat_ws(" ", "words"), 256).alias("window_id"), F.size("words").alias("length"), "words")
        .distinct()
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place where a document holds a window: ``(doc, copy, start, length, item)``.

    ``copy`` is a hash of the text, so that different texts under one id stay apart.
    """
    owned = stage(item_windows(benchmark, window), "windows")
    parts = stage(
        owned.select("window_id", "length", "words")
        .distinct()
        .withColumn("n", F.least(F.lit(SHINGLE), "length"))
        .withColumn(
            "token",
            F.explode(F.when(F.col("n") == 1, F.arrays_zip(shingle_hashes(F.col("words"), 1).alias("h"), F.sequence(F.lit(0), F.col("length")).alias("o")))
            .when(F.col("n") == 2, F.arrays_zip(shingle_hashes(F.col("words"), 2).alias("h"), F.sequence(F.lit(0), F.col("length")).alias("o")))
            .otherwise(F.arrays_zip(shingle_hashes(F.col("words"), 3).alias("h"), F.sequence(F.lit(0), F.col("length")).alias("o")))),
        )
        .where(F.col("token.h").isNotNull())
        .select("window_id", "length", "words", "n", F.col("token.h").alias("h"), F.col("token.o").alias("offset")),
        "window-shingles",
    )
    tokens = parts.select("n", "h").distinct()
    widths = sorted(r[0] for r in parts.select("n").distinct().collect())  # of 1, 2 and 3
    read = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), words(text_col).alias("w"))
    places = None
    for n in widths or [SHINGLE]:
        own = (
            read.select("doc", "copy", F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), n)).alias("pos", "h"))
            .join(_small(tokens.where(F.col("n") == n).select("h")), "h")
            .withColumn("n", F.lit(n))
        )
        places = own if places is None else places.unionByName(own)
    hits = stage(places, "shingle-hits")
    counts = hits.groupBy("n", "h").agg(F.count("*").alias("df"))
    # the prefix of each window: its rarest shingle; a window with a shingle that occurs nowhere occurs nowhere
    ranked = parts.join(_small(counts), ["n", "h"], "left").groupBy("window_id").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("least"),
        F.min_by(F.struct("n", "h", "offset"), F.struct(F.coalesce("df", F.lit(0)), "offset")).alias("t"),
        F.first("length").alias("length"),
        F.first("words").alias("words"),
    )
    prefixes = stage(ranked.where("least > 0").select("window_id", "length", "words", "t.*"), "prefixes")
    starts = (
        hits.join(_small(prefixes.select("n", "h", "offset", "window_id", "length")), ["n", "h"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("doc", "copy", "start", "length", "window_id")
        .distinct()
    )
    held = starts.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "length", "window_id")).alias("at"))
    # texts are read a second time, and only those of documents with candidates are split into words
    sources = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    checked = (
        sources.join(held, (sources.doc.eqNullSafe(held.doc)) & (sources["copy"] == held["copy"]))
        .select(sources.doc, sources["copy"], words("text").alias("w"), "at")
        .select("doc", "copy", F.explode(F.transform("at", lambda x: F.struct(x.start.alias("start"), x.length.alias("length"), x.window_id.alias("window_id"), F.slice(F.col("w"), x.start + 1, x.length).alias("words")))).alias("x"))
        .select("doc", "copy", "x.*")
    )
    return checked.join(_small(owned), ["window_id", "length", "words"]).select("doc", "copy", "start", "length", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, n_words, n_hit, n_items, items_sha256, contaminated)``."""
    found = stage(occurrences(docs, benchmark, window, id_col, text_col), "occurrences")
    before = Window.partitionBy("doc", "copy").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select("doc", "copy", "start", (F.col("start") + F.col("length")).alias("end"))
        .distinct()
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("doc", "copy")
        .agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    )
    named = found.select("doc", "copy", F.col("item").cast("string").alias("item")).distinct().groupBy("doc", "copy").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found_per_doc = covered.join(named, (covered.doc.eqNullSafe(named.doc)) & (covered["copy"] == named["copy"])).select(covered.doc.alias("doc_"), covered["copy"].alias("copy_"), "n_hit", "items")
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.size(words(text_col)).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return own.join(found_per_doc, own.doc.eqNullSafe(F.col("doc_")) & (F.col("copy") == F.col("copy_")), "left").select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no window, with all their columns, whatever their names."""
    found = occurrences(docs, benchmark, window, id_col, text_col).select("doc", "copy").distinct()
    aside = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])
    same = F.col(f"`own_{id_col}`").eqNullSafe(F.col("doc")) & (F.xxhash64(F.col(f"`own_{text_col}`")) == F.col("copy"))
    return aside.join(found, same, "left_anti").select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])

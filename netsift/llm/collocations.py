"""Collocations of two and three words by best-first branch and bound.

A phrase's score is its count squared over the counts of its two parts, at the cut where
that is least. Word counts come first, for all documents. They bound every longer phrase
that they are part of: a phrase occurs no more often than its rarest word, so two words
score at most the rarer over the commoner, and three words at most the rarest over the
commoner of the outer two. The frontier is opened from the top: a round counts, in all
texts of the languages still open, the phrases whose bound reaches the round's score,
then the parts of the phrases found and the phrases around the pairs found (those decide
which pairs are dropped). A language is settled when ``top`` surviving phrases reach the
round's score: all that could still come, ties included, scores less. The last round has
no bound and settles the rest.

Tasks look words up in a table of ``SLOTS`` hashed slots with the least and largest count
of a frequent word in each: its size is fixed, a shared slot only loosens a bound. The same
holds for the bit table of pairs to look for. Counts, scores and the choice are exact.

Edge cases: a null language is ``und``; null, empty and blank texts have no words; repeated
rows count each time; pieces of one word make no phrase; ties go to the larger count and
then to the smaller phrase in byte order; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, free_shuffles, release, slices, stage

#: slots of the word table, and bits of the pair table; both are bounds on what is broadcast
SLOTS, BITS = 1 << 22, 1 << 25
#: scores, in millionths, that the rounds go down to
ROUNDS = (125_000, 7_812, 488, 30, 0)
#: distinct words or phrases that a task holds at once
HELD = 250_000
_CUT = b",;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _CUT, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_CUT))


def marked_words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, with a full stop between pieces; no word is one."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split() if text else []


def _counted(docs: DataFrame, rows_of: Callable[[str, list[bytes]], Iterator[bytes]]) -> DataFrame:
    """``(lang, phrase, f)``: how often each phrase that ``rows_of`` gives occurs. Each task counts first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            out = [(lang, phrase.decode("utf-8", "surrogatepass"), f) for lang, own in counts.items() for phrase, f in own.items()]
            counts.clear()
            return pd.DataFrame(out, columns=["lang", "phrase", "f"])

        for frame in slices(frames, "text"):
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                counts.setdefault(lang, Counter()).update(rows_of(lang, marked_words(text)))
            if sum(map(len, counts.values())) > HELD:
                yield flush()
        yield flush()

    return docs.mapInPandas(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, phrase, f)`` of single words."""
    return _counted(docs, lambda lang, tokens: (w for w in tokens if w != b"."))


def _word_table(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest count of the frequent words of each slot; zero where there is none."""
    found = words.where(F.col("f") >= least).groupBy(F.xxhash64("lang", "phrase").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.min("f").alias("lo"), F.max("f").alias("hi")).toPandas()
    lo, hi = np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)
    lo[found["slot"]] = np.nextafter(found["lo"].to_numpy(np.float32), np.float32(0))
    hi[found["slot"]] = np.nextafter(found["hi"].to_numpy(np.float32), np.float32(np.inf))
    return lo, hi


def _pair_bits(hashes: np.ndarray) -> np.ndarray:
    """Bit of each two neighbouring words in a pair table, from the words' hashes."""
    x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:] * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(39)).astype(np.int64)


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """One bit for each hashed ``(lang, phrase)`` of two words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _Lookup()
        for frame in frames:
            at = [int(_pair_bits(lookup.hashes(lang, phrase.encode().split(b" ")))[0]) for lang, phrase in zip(frame["lang"], frame["phrase"], strict=True)]
            yield pd.DataFrame({"at": np.array(at, dtype=np.int64)})

    at = pairs.select("lang", "phrase").mapInPandas(run, "at long")
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[found["word"]] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


class _Lookup:
    """Hashes of a task's words, language by language."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}

    def hashes(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        """What ``xxhash64(lang, word)`` gives in Spark, unsigned; 0 at the end of a piece."""
        if sum(map(len, self.known.values())) > HELD:
            self.known.clear()
        own = self.known.setdefault(lang, {b".": 0})
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        for w in set(tokens).difference(own):
            own[w] = xxhash.xxh64_intdigest(w, seed)
        return np.fromiter(map(own.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _open_phrases(docs: DataFrame, table, score: int) -> DataFrame:
    """Counts of all phrases whose bound reaches the score."""
    cut = np.float32(score / 1e6 * (1 - 1e-6))

    def rows_of(lang: str, tokens: list[bytes], lookup: _Lookup) -> Iterator[bytes]:
        if len(tokens) < 2:
            return
        lo, hi = table.value
        hashes = lookup.hashes(lang, tokens)
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        low, high = np.where(hashes > 0, lo[at], 0), np.where(hashes > 0, hi[at], 0)
        is_word = high > 0
        pair = is_word[1:] & is_word[:-1] & (np.minimum(high[1:], high[:-1]) >= cut * np.maximum(low[1:], low[:-1]))
        for k in np.flatnonzero(pair).tolist():
            yield b" ".join(tokens[k : k + 2])
        inner = is_word[2:] & is_word[1:-1] & is_word[:-2]
        least = np.minimum(np.minimum(high[2:], high[1:-1]), high[:-2])
        for k in np.flatnonzero(inner & (least >= cut * np.maximum(low[2:], low[:-2]))).tolist():
            yield b" ".join(tokens[k : k + 3])

    return _with_lookup(docs, rows_of)


def _phrases_around(docs: DataFrame, tables) -> DataFrame:
    """Counts of the pairs in the first bit table, and of the three-word phrases that hold a pair of the second."""

    def rows_of(lang: str, tokens: list[bytes], lookup: _Lookup) -> Iterator[bytes]:
        if len(tokens) < 2:
            return
        hashes = lookup.hashes(lang, tokens)
        inside = (hashes[1:] > 0) & (hashes[:-1] > 0)
        at = _pair_bits(hashes)
        part, kept = (inside & ((t[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0) for t in tables.value)
        for k in np.flatnonzero(part).tolist():
            yield b" ".join(tokens[k : k + 2])
        for k in np.flatnonzero((kept[1:] | kept[:-1]) & inside[1:] & inside[:-1]).tolist():
            yield b" ".join(tokens[k : k + 3])

    return _with_lookup(docs, rows_of)


def _with_lookup(docs: DataFrame, rows_of: Callable) -> DataFrame:
    """``_counted`` with the hashes that a task keeps between texts."""

    class Keep:
        own = None

        def __call__(self, lang: str, tokens: list[bytes]) -> Iterator[bytes]:
            if self.own is None:
                self.own = _Lookup()
            return rows_of(lang, tokens, self.own)

    return _counted(docs, Keep())


def _scored(phrases: DataFrame, left: str, right: str) -> Column:
    """``floor(1000000 a a / (l r))`` in whole numbers of 38 digits."""
    return F.expr(f"CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * 1000000BD div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def _round(docs: DataFrame, words: DataFrame, table, score: int, least: int, share: int) -> DataFrame:
    """All phrases that score at least ``score``, without the dropped ones: ``(lang, phrase, a, l, r, score)``."""
    spark = docs.sparkSession
    found = stage(_open_phrases(docs, table, score).where(F.col("f") >= least).withColumn("w", F.split("phrase", " ")), "open-phrases")
    free_shuffles(spark)
    single = words.where(F.col("f") >= least)

    def with_count(df: DataFrame, counts: DataFrame, phrase: Column, name: str) -> DataFrame:
        own = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
        return df.join(own, (F.col("lang") == F.col("_l")) & (phrase == F.col("_p"))).drop("_l", "_p")

    w = [F.col("w")[k] for k in range(3)]
    twos = found.where(F.size("w") == 2).withColumnRenamed("f", "a")
    twos = with_count(with_count(twos, single, w[0], "l"), single, w[1], "r")
    twos = stage(twos.withColumn("score", _scored(twos, "l", "r")).where(F.col("score") >= score).drop("w"), "open-pairs")
    threes = found.where(F.size("w") == 3).withColumnRenamed("f", "a")
    head, tail = F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2])
    parts = threes.select("lang", F.explode(F.array(head, tail)).alias("phrase")).distinct()
    tables = spark.sparkContext.broadcast((_bit_table(parts), _bit_table(twos.select("lang", "phrase"))))
    around = stage(_phrases_around(docs, tables).where(F.col("f") >= least).withColumn("w", F.split("phrase", " ")), "phrases-around")
    pairs = around.where(F.size("w") == 2).select("lang", "phrase", "f")
    for name, counts, phrase in (("f_1", single, w[0]), ("f_23", pairs, tail), ("f_12", pairs, head), ("f_3", single, w[2])):
        threes = with_count(threes, counts, phrase, name)
    threes = threes.withColumn("s_1", _scored(threes, "f_1", "f_23")).withColumn("s_2", _scored(threes, "f_12", "f_3"))
    first = F.col("s_1") <= F.col("s_2")
    threes = threes.select("lang", "phrase", "a", F.when(first, F.col("f_1")).otherwise(F.col("f_12")).alias("l"), F.when(first, F.col("f_23")).otherwise(F.col("f_3")).alias("r"), F.least("s_1", "s_2").alias("score"))
    longer = around.where(F.size("w") == 3).select("lang", F.explode(F.array(head, tail)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = twos.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).drop("longest")
    out = stage(kept.select("lang", "phrase", "a", "l", "r", "score").unionByName(threes.where(F.col("score") >= score)), "surviving-phrases")
    release(found, twos, around)
    free_shuffles(spark)
    return out


def collocations(
    docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, rounds: tuple[int, ...] = ROUNDS, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A phrase of at least ``least`` occurrences is a candidate; it is dropped if a longer candidate that
    holds it has ``share`` per cent of its occurrences.
    """
    if rounds[-1] != 0 or least < 1:
        raise ValueError("the last round must have no bound, and least be at least 1")
    spark = docs.sparkSession
    named = bound_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.col("text") != "")
    words = stage(word_counts(named), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    free_shuffles(spark)
    table = spark.sparkContext.broadcast(_word_table(words, least))
    settled: list[str] = []
    chosen = None
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    for score in rounds:
        # each settled language has ``top`` phrases of its own, so there are few
        own = named.where(~F.col("lang").isin(settled)) if settled else named
        found = _round(own, words, table, score, least, share)
        ready = found.groupBy("lang").count()
        ready = [r.lang for r in (ready.where(F.col("count") >= top) if score else ready).collect()]
        if ready:
            part = found.where(F.col("lang").isin(ready)) if score else found
            part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            chosen = part if chosen is None else chosen.unionByName(part)
            settled += ready
        if not words.where(~F.col("lang").isin(settled) & (F.col("f") >= least)).limit(1).count():
            break
    if chosen is None:
        chosen = found.withColumn("rank", F.lit(1)).limit(0)
    return chosen.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

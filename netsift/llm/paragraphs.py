"""Substring dedup: repeated passages, found paragraph by paragraph.

A paragraph is a line of a text; one of at least ``min_paragraph`` words (one
shingle) takes part. Equal paragraphs are one item from the start. Items whose
MinHash bands collide are compared by exact Jaccard similarity of their full
shingle sets, and components of the confirmed links say which paragraphs are
versions of one passage. The first paragraph of a component (smallest document,
then position) stays; every paragraph of another document is a repeat.

What counts as a passage is decided per document: a run of neighbouring repeats
(paragraphs too short to take part do not interrupt it) of at least
``min_words`` words is removed, so that a common heading or licence line in an
otherwise new text stays.

Passages that keep no line breaks come second (``repeated_spans``). Places of a text
are chosen by its words alone (minima of hashed word runs over a moving window), so
texts that share a run of 23 words share a place in it, wherever their lines break.
Each place leads to the first document with it and to the one before in the order of
ids. Documents that meet at two places or more are compared word by word outwards
from there, over single changed, missing or added words. A stretch of more than
``span_words`` words, four fifths of them equal, is a passage, and the words of it
that the paragraphs have left are cut. Where a place has further earlier documents,
whole runs of ``span_words + 1`` words over it are looked up in all of them, so a
passage that any earlier document holds word for word is cut. Whole lines too short to be paragraphs stay
where fewer than 30 words are left together.

Edge cases: null and empty texts have no paragraphs; repeats inside one document
stay; rows that share an id and a text are one document, those that share only the
id are told apart by a hash of the text; rows without an id are left alone. Ids are
whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import free_shuffles, release, slices, stage
from netsift.llm.minhash import Bands, shingle_hashes, similar_groups, words


def _distinct_places(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(places)), places)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(places))


def paragraph_hash(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) - (1 << 63)


def paragraphs(docs: DataFrame, shingle: int, bands: Bands, min_paragraph: int) -> DataFrame:
    """One row per paragraph: ``(doc, copy, pos, idx, n_words, id, n, keys, sig)``.

    ``idx`` numbers the paragraphs that take part; ``id`` hashes the words. Band keys and minima are
    given once per distinct paragraph and task, else null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[int] = set()
        for frame in slices(frames, "text"):
            rows, fresh = [], []
            for doc, copy, text in frame[["doc", "copy", "text"]].itertuples(index=False, name=None):
                idx = 0
                for pos, line in enumerate((text or "").split("\n")):
                    tokens = words(line)
                    if len(tokens) < min_paragraph:
                        continue
                    name = paragraph_hash(tokens)
                    if name not in given:
                        given.add(name)
                        fresh.append((len(rows), tokens))
                    rows.append((doc, copy, pos, idx, len(tokens), name))
                    idx += 1
            if len(given) > 2_000_000:
                given.clear()
            out = pd.DataFrame(rows, columns=["doc", "copy", "pos", "idx", "n_words", "id"])
            out["n"] = pd.Series(pd.NA, index=out.index, dtype="Int64")
            out["keys"], out["sig"] = None, None
            if fresh:
                at = [i for i, _ in fresh]
                hashes, places = _distinct_places(*shingle_hashes([t for _, t in fresh], shingle))
                keys, sig = bands.sign(hashes, places)
                out.loc[at, "n"] = places
                out.loc[at, "keys"] = pd.Series(list(keys), index=at, dtype=object)
                out.loc[at, "sig"] = pd.Series([x.tobytes() for x in sig], index=at, dtype=object)
            yield out

    return docs.mapInPandas(run, "doc long, copy long, pos int, idx int, n_words int, id long, n int, keys array<long>, sig binary")


def _repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """Ids of more than one row: only these documents need a hash of the text beside the id."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).count()
    return stage(ids.where("count > 1").select("doc", F.lit(True).alias("again")), "repeated-ids")


def _named(docs: DataFrame, again: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, copy, text)``; ``copy`` is 0 where the id has one row."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if again.isEmpty():
        return own.select("doc", F.lit(0).cast("long").alias("copy"), "text")
    return own.join(again, "doc", "left").select("doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("copy"), "text")


def repeated_paragraphs(
    docs: DataFrame,
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    min_paragraph: int = 5,
    min_words: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Paragraphs to remove: ``(doc, copy, pos, n_words, run_words, component, kept_doc, kept_pos)``."""
    bands = Bands.tuned(num / den, rows=3, miss=1e-4)
    named = _named(docs, _repeated_ids(docs, id_col), id_col, text_col)
    found = stage(paragraphs(named, shingle, bands, min_paragraph), "paragraphs")
    items = found.where("sig IS NOT NULL").select("id", "n", "keys", "sig")
    places = stage(found.select("doc", "copy", "pos", "idx", "n_words", "id"), "paragraph-places")

    def texts_of(ids: DataFrame) -> DataFrame:
        """One text of each paragraph, read again from the documents that hold its first place."""
        first = found.where("sig IS NOT NULL").join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "copy", "pos")).alias("at"))
        wanted = first.groupBy("at.doc", "at.copy").agg(F.collect_list(F.struct("id", F.col("at.pos").alias("pos"))).alias("wanted"))
        lines = F.split(F.col("text"), "\n", -1)
        return (
            named.join(wanted, ["doc", "copy"])
            .select(F.explode(F.transform("wanted", lambda w: F.struct(w.id.alias("id"), F.get(lines, w.pos).alias("text")))).alias("x"))
            .select("x.*")
            .dropDuplicates(["id"])
        )

    labels, _ = similar_groups(items, texts_of, bands, shingle, num, den)
    release(found)
    grouped = places.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # written, so that the join below is planned by itself and a component with many places can be split
    firsts = stage(
        grouped.groupBy("component")
        .agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last_doc"))
        .where("last_doc <> first.doc")
        .select("component", F.col("first.doc").alias("kept_doc"), F.col("first.pos").alias("kept_pos")),
        "paragraph-firsts",
    )
    free_shuffles(docs.sparkSession)
    repeats = grouped.join(firsts, "component").where("doc <> kept_doc").distinct()
    own = Window.partitionBy("doc", "copy").orderBy("idx")
    runs = repeats.withColumn("run", F.col("idx") - F.row_number().over(own)).withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc", "copy", "run")))
    out = runs.where(F.col("run_words") >= min_words).select("doc", "copy", "pos", "n_words", "run_words", "component", "kept_doc", "kept_pos")
    out = stage(out, "repeated-paragraphs")
    release(places, firsts)
    free_shuffles(docs.sparkSession)
    return out


GRAM, SPREAD = 8, 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _anchors(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose run of ``GRAM`` words has the least hash of some ``SPREAD`` neighbouring runs of its text.

    The hashes and the places of all texts end to end, and the number of places of each text. A text of fewer runs has
    one place, of fewer than ``GRAM`` words none.
    """
    sizes = np.zeros(len(texts), dtype=np.int64)
    long = [i for i, t in enumerate(texts) if len(t) >= GRAM]
    if not long:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), sizes
    hashes, runs = shingle_hashes([texts[i] for i in long], GRAM)
    first = np.cumsum(runs) - runs
    owner = np.repeat(np.arange(len(long)), runs)
    chosen = np.zeros(len(hashes), dtype=bool)
    few = np.flatnonzero(runs < SPREAD)
    chosen[[f + int(hashes[f : f + n].argmin()) for f, n in zip(first[few], runs[few], strict=True)]] = True
    if len(hashes) >= SPREAD:
        starts = len(hashes) - SPREAD + 1
        least, at = hashes[:starts].copy(), np.arange(starts)
        for k in range(1, SPREAD):
            smaller = hashes[k : k + starts] < least
            least[smaller] = hashes[k : k + starts][smaller]
            at[smaller] = np.flatnonzero(smaller) + k
        chosen[at[owner[:starts] == owner[SPREAD - 1 :]]] = True
    places = np.flatnonzero(chosen)
    sizes[long] = np.bincount(owner[places], minlength=len(long))
    return hashes[places], places - first[owner[places]], sizes


def _places(docs: DataFrame) -> DataFrame:
    """``(key, doc, copy, at)``: chosen places of each text; ``at`` counts words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 1 << 20):
            keys, places, sizes = _anchors([words(text) for text in frame["text"]])
            out = {"key": keys.view(np.int64), "at": places.astype(np.int32)}
            yield pd.DataFrame(out | {c: np.repeat(frame[c].to_numpy(dtype=np.int64), sizes) for c in ("doc", "copy")})[["key", "doc", "copy", "at"]]

    return docs.mapInPandas(run, "key long, doc long, copy long, at int")


def _edits(gap: int) -> list[tuple[int, int]]:
    """Words of either side to step over at an edit, the smallest first."""
    return sorted(((x, y) for x in range(gap + 1) for y in range(gap + 1) if x or y), key=lambda e: (max(e), sum(e)))


_STEPS = _edits(3)


def _equal_words(a: list[bytes], b: list[bytes], i: int, j: int, step: int) -> int:
    """How many words of a from place ``i`` on are those of b from ``j`` on; compared in stretches that double."""
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
    done, size = 0, 8
    while done < most:
        n = min(size, most - done)
        x, y = (i + done, j + done) if step > 0 else (i - done - n + 1, j - done - n + 1)
        left, right = a[x : x + n], b[y : y + n]
        if left != right:
            pairs = zip(left, right, strict=True) if step > 0 else zip(reversed(left), reversed(right), strict=True)
            return done + next(k for k, (v, w) in enumerate(pairs) if v != w)
        done, size = done + n, 2 * size
    return done


def _extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int, gap: int = 3, equal: int = 4, cost: int = 4) -> tuple[int, int, int]:
    """From places ``i`` and ``j`` on: words of a and b, and equal words, up to the best score (one a word, less ``cost`` an edit)."""
    start_i, start_j, same, edits, score = i, j, 0, 0, 0
    best, ends = 0, (0, 0, 0)
    steps = _STEPS if gap == 3 else _edits(gap)
    # the words that must follow an edit lie at least ``low`` and less than ``high`` words from it on
    low, high = (0, equal) if step > 0 else (1 - equal, 1)
    while True:
        run = _equal_words(a, b, i, j, step)
        i, j, same = i + step * run, j + step * run, same + run
        score = same - cost * edits
        if score > best:
            best, ends = score, (abs(i - start_i), abs(j - start_j), same)
        if score < best - 5 * cost:
            return ends
        for total in steps:
            x, y = i + step * total[0], j + step * total[1]
            if x + low < 0 or y + low < 0 or x + high > len(a) or y + high > len(b) or a[x] != b[y]:
                continue
            if a[x + low : x + high] == b[y + low : y + high]:
                i, j, edits = x, y, edits + max(total)
                break
        else:
            return ends


def shared_spans(a: list[bytes], b: list[bytes], seeds: list[tuple[int, int]], more_than: int) -> list[tuple[int, int, int]]:
    """``(from, to, from in b)``: stretches of over ``more_than`` words of a that b holds too, found from common places."""
    tried: list[tuple[int, int, int]] = []
    found = []
    for i, j in sorted(set(seeds)):
        if any(lo <= i < hi and abs((j - i) - shift) <= 3 + (hi - lo) // 5 for lo, hi, shift in tried[-50:]) or a[i : i + GRAM] != b[j : j + GRAM]:
            continue
        back_a, back_b, _ = _extend(a, b, i - 1, j - 1, -1) if i and j else (0, 0, 0)
        on_a, _, _ = _extend(a, b, i, j, 1)
        tried.append((i - back_a, i + on_a, j - i))
        if back_a + on_a > more_than:
            found.append((i - back_a, i + on_a, j - back_b))
    return found


def _lines_of(text: str) -> list[tuple[int, int, list[tuple[int, int]], int]]:
    """``(pos, first word, characters from and to of its words, character at its end)`` of each line."""
    lines, at, offset = [], 0, 0
    for pos, line in enumerate(text.split("\n")):
        found = [(m.start() + offset, m.end() + offset) for m in _WORD.finditer(line)]
        lines.append((pos, at, found, offset + len(line)))
        at, offset = at + len(found), offset + len(line) + 1
    return lines


def _pieces(lines: list[tuple], spans: list[tuple[int, int]], gone: set[int], min_paragraph: int, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """``(pos, char_from, char_to, n_words, first word)`` to cut: parts of lines inside the spans, without lines that are gone already."""
    out = []
    for lo, hi in spans:
        parts = []  # runs of neighbouring parts that are left
        for pos, first, found, end in lines:
            x, y = max(lo, first), min(hi, first + len(found))
            if x >= y:
                continue
            if pos in gone:
                parts.append([])
                continue
            stop = end if y == first + len(found) else found[y - first][0]
            if not parts:
                parts.append([])
            parts[-1].append((pos, found[x - first][0], stop, y - x, x, len(found)))
        for run in parts:
            enough = sum(p[3] for p in run) >= min_words
            out += [p[:5] for p in run if enough or p[5] >= min_paragraph or p[3] < p[5]]
    return sorted(set(out))


def repeated_spans(docs: DataFrame, gone: DataFrame, span_words: int = 50, min_paragraph: int = 5, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts of lines to cut, whatever the line breaks: ``(doc, copy, pos, char_from, char_to, n_words, run_words, kept_doc, kept_pos)``.

    ``gone`` holds ``(doc, copy, pos)`` of the lines that go anyway. Characters are counted from the start of the text.
    """
    spark = docs.sparkSession
    again = _repeated_ids(docs, id_col)
    named = _named(docs, again, id_col, text_col)
    order = Window.partitionBy("key").orderBy("doc", "copy", "at")
    place = F.struct(F.col("doc").alias("kept_doc"), F.col("copy").alias("kept_copy"), F.col("at").alias("kept_at"))
    met = _places(named).withColumn("first", F.first(place).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag(place).over(order))
    # the fourth row of a key and later ones have more earlier rows than the two that they are compared with
    met = stage(met.withColumn("more", F.row_number().over(order) > 3).where("before IS NOT NULL"), "met-places")
    free_shuffles(spark)
    pairs = met.select("doc", "copy", "at", F.explode(F.array_distinct(F.array("first", "before"))).alias("kept")).where("kept.kept_doc <> doc")
    # two places at least; a passage has two in any 39 words that are not changed
    found = _compared(named, again, gone, _seeds(pairs.select("doc", "copy", "at", "kept.*")).where(F.size("ats") > 1), span_words, min_paragraph, min_words)
    many = met.where("more").select("key").distinct()
    if not many.isEmpty():
        pairs = _whole_windows(named, again, gone, met.join(many, "key", "left_semi"), found, span_words + 1)
        rest = _compared(named, again, gone, _seeds(pairs), span_words, min_paragraph, min_words, span_words + 1)
        release(pairs)
        found = found.union(rest.join(found, [c for c in found.columns if c != "run_words"], "left_anti"))
    release(met)
    return found.drop("word_from", "word_to")


def _seeds(pairs: DataFrame) -> DataFrame:
    """``(doc, copy, kept_doc, kept_copy, ats, kept_ats)`` of pairs of places."""
    found = pairs.groupBy("doc", "copy", "kept_doc", "kept_copy").agg(F.sort_array(F.collect_set(F.struct("at", "kept_at"))).alias("seeds"))
    # plain numbers stay small in Python
    return found.select("doc", "copy", "kept_doc", "kept_copy", F.col("seeds.at").alias("ats"), F.col("seeds.kept_at").alias("kept_ats"))


def _texts_of(named: DataFrame, own: DataFrame, again: DataFrame) -> DataFrame:
    """One text of each document; only rows of repeated ids can be the same document."""
    found = named.join(own, ["doc", "copy"], "left_semi")
    return found if again.isEmpty() else found.groupBy("doc", "copy").agg(F.first("text").alias("text"))


def _gone_words(text: str, lines_gone: set[int]) -> np.ndarray:
    """Which words of a text lie in lines that go anyway."""
    lines = text.split("\n")
    return np.repeat([pos in lines_gone for pos in range(len(lines))], [len(words(line)) for line in lines])


def _whole_windows(named: DataFrame, again: DataFrame, gone: DataFrame, met: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """``(doc, copy, at, kept_doc, kept_copy, kept_at)``: runs of ``size`` words and the first document that has them.

    The exact way for keys of four rows and more. A run of ``size`` words has a place in it; where a document's place has earlier
    rows that were not looked at, all runs over it that are not cut yet ask for the first document with the very run. Documents give
    all runs over places with such a key, so each run meets one other document, however many have it.
    """
    firsts = met.select(F.col("first.kept_doc").alias("doc"), F.col("first.kept_copy").alias("copy"), F.col("first.kept_at").alias("at"), F.lit(False).alias("more"))
    rows = met.select("doc", "copy", "at", "more").union(firsts.distinct()).groupBy("doc", "copy")
    rows = rows.agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("more"), F.col("at"))).alias("asking"))
    spans = found.groupBy("doc", "copy").agg(F.collect_set(F.struct("word_from", "word_to")).alias("spans"))
    spans = spans.select("doc", "copy", F.col("spans.word_from").alias("lows"), F.col("spans.word_to").alias("highs"))
    lines = gone.groupBy("doc", "copy").agg(F.collect_set("pos").alias("gone"))
    texts = _texts_of(named, rows, again).join(rows, ["doc", "copy"]).join(spans, ["doc", "copy"], "left").join(lines, ["doc", "copy"], "left")

    def over(ats: np.ndarray, runs: int) -> np.ndarray:
        """Which runs of words hold a whole place."""
        steps = np.zeros(runs + 1, dtype=np.int64)
        np.add.at(steps, np.clip(ats + GRAM - size, 0, runs), 1)
        np.add.at(steps, np.clip(ats + 1, 0, runs), -1)
        return steps[:-1].cumsum() > 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 1 << 20):
            texts = [words(text) for text in frame["text"]]
            long = [i for i, t in enumerate(texts) if len(t) >= size]
            if not long:
                continue
            hashes, counts = shingle_hashes([texts[i] for i in long], size)
            out, start = [], 0
            for i, runs in zip(long, counts.tolist(), strict=True):
                row = frame.iloc[i]
                cut = np.zeros(len(texts[i]), dtype=bool) if row["gone"] is None else _gone_words(row["text"], set(map(int, row["gone"])))
                for lo, hi in zip(row["lows"], row["highs"], strict=True) if row["lows"] is not None else ():
                    cut[lo:hi] = True
                sums = np.append(0, cut.cumsum())
                ask = over(np.asarray(row["asking"], dtype=np.int64), runs) & (sums[size:] - sums[:-size] < size)
                at = np.flatnonzero(over(np.asarray(row["ats"], dtype=np.int64), runs))
                out.append(pd.DataFrame({"run": hashes[start + at].view(np.int64), "doc": row["doc"], "copy": row["copy"], "at": at.astype(np.int32), "ask": ask[at]}))
                start += runs
            yield pd.concat(out)

    given = stage(texts.mapInPandas(run, "run long, doc long, copy long, at int, ask boolean"), "whole-runs")
    first = F.min(F.struct("doc", "copy", "at")).alias("first")
    firsts = given.groupBy("run").agg(first, F.max("doc").alias("last_doc"), F.max("ask").alias("asked")).where("asked AND last_doc <> first.doc")
    firsts = firsts.select("run", *[F.col(f"first.{c}").alias(f"kept_{c}") for c in ("doc", "copy", "at")])
    out = stage(given.where("ask").join(firsts, "run").where("doc <> kept_doc").drop("run", "ask"), "whole-windows")
    release(given)
    free_shuffles(named.sparkSession)
    return out


def _equal_spans(a: list[bytes], b: list[bytes], starts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """``(from, to, from in b)``: runs of ``size`` equal words, neighbouring ones as one."""
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(set(starts), key=lambda s: (s[1] - s[0], s[0])):
        if out and out[-1][2] - out[-1][0] == j - i and i <= out[-1][1]:
            low, k = out[-1][0], out[-1][1]
            if a[k : i + size] == b[k + j - i : j + size]:
                out[-1] = (low, i + size, out[-1][2])
        elif a[i : i + size] == b[j : j + size]:
            out.append((i, i + size, j))
    return out


def _compared(named: DataFrame, again: DataFrame, gone: DataFrame, seeds: DataFrame, span_words: int, min_paragraph: int, min_words: int, whole: int | None = None) -> DataFrame:
    """The parts of lines to cut, and ``(word_from, word_to)`` of their spans, of documents that meet at ``seeds``; written.

    Seeds are places, or with ``whole`` runs of so many words, which are found however the words around them compare.
    """
    spark = named.sparkSession
    seeds = stage(seeds, "seeds")
    free_shuffles(spark)
    own = seeds.select("doc", "copy").union(seeds.select("kept_doc", "kept_copy")).distinct()
    texts = _texts_of(named, own, again)
    lines = gone.groupBy("doc", "copy").agg(F.collect_set("pos").alias("gone"))
    kept = texts.select(F.col("doc").alias("kept_doc"), F.col("copy").alias("kept_copy"), F.col("text").alias("kept_text"))
    pairs = seeds.join(lines, ["doc", "copy"], "left").join(kept, ["kept_doc", "kept_copy"]).join(texts, ["doc", "copy"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            # the rows of a document come together: its words and lines are told apart once
            rows, last, a, lines_gone, line_of, lines_in = [], None, [], set(), None, None
            columns = ["doc", "copy", "text", "gone", "kept_doc", "kept_text", "ats", "kept_ats"]
            for doc, copy, text, out, kept_doc, kept_text, ats, kept_ats in frame[columns].itertuples(index=False, name=None):
                if (doc, copy) != last:
                    last, a, lines_gone, line_of, lines_in = (doc, copy), words(text), set() if out is None else set(map(int, out)), None, None
                starts = list(zip(map(int, ats), map(int, kept_ats), strict=True))
                if lines_gone and not whole:
                    # what lies in lines that go anyway needs no look
                    if line_of is None:
                        line_of = np.repeat(np.arange(text.count("\n") + 1), [len(words(line)) for line in text.split("\n")]).tolist()
                    starts = [(i, j) for i, j in starts if line_of[i] not in lines_gone or line_of[i + GRAM - 1] not in lines_gone]
                if not starts:
                    continue
                b = words(kept_text)
                spans = shared_spans(a, b, starts, span_words)
                if whole:
                    spans += [s for s in _equal_spans(a, b, starts, whole) if not any(lo <= s[0] and s[1] <= hi for lo, hi, _ in spans)]
                if not spans:
                    continue
                lines_in = lines_in or _lines_of(text)
                before = np.cumsum([len(words(line)) for line in kept_text.split("\n")])
                for lo, hi, other in spans:
                    other_pos = int(np.searchsorted(before, other, side="right"))
                    for pos, start, end, n, _ in _pieces(lines_in, [(lo, hi)], lines_gone, min_paragraph, min_words):
                        rows.append((doc, copy, pos, start, end, n, hi - lo, kept_doc, other_pos, lo, hi))
            yield pd.DataFrame(rows, columns=["doc", "copy", "pos", "char_from", "char_to", "n_words", "run_words", "kept_doc", "kept_pos", "word_from", "word_to"])

    found = stage(pairs.mapInPandas(run, "doc long, copy long, pos int, char_from int, char_to int, n_words int, run_words int, kept_doc long, kept_pos int, word_from int, word_to int"), "found-spans")
    release(seeds)
    free_shuffles(spark)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 50, **options) -> DataFrame:
    """Lines to remove, as ``repeated_paragraphs`` has them (no ``char_from``), and parts of lines, as ``repeated_spans`` has them (no ``component``)."""
    whole = repeated_paragraphs(docs, id_col=id_col, text_col=text_col, **options)
    least = {k: v for k, v in options.items() if k == "min_paragraph"}
    out = stage(whole.unionByName(repeated_spans(docs, whole, span_words, id_col=id_col, text_col=text_col, **least), allowMissingColumns=True), "repeated-passages")
    release(whole)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents without their repeated passages, all columns kept; a count of characters is brought up to date.

    A document of which nothing is left but repeats becomes the empty text. A line of which nothing is left goes with its line
    break. The table's own columns may have any names: they are set aside meanwhile.
    """
    part = F.when(F.col("char_from").isNotNull(), F.struct("char_from", "char_to"))
    gone = repeated_passages(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc", "copy")
    gone = gone.agg(F.collect_set(F.when(F.col("char_from").isNull(), F.col("pos"))).alias("_gone"), F.sort_array(F.collect_set(part)).alias("_parts"))
    gone = gone.select(F.col("doc").alias("_doc"), F.col("copy").alias("_of"), "_gone", "_parts")
    aside = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])
    key, own = F.col(f"`own_{id_col}`").cast("long"), F.col(f"`own_{text_col}`")
    again = _repeated_ids(docs, id_col)
    if again.isEmpty():
        keyed = aside.withColumn("_copy", F.lit(0).cast("long"))
    else:
        keyed = aside.join(again.select(F.col("doc").alias("_again")), key == F.col("_again"), "left")
        keyed = keyed.withColumn("_copy", F.when(F.col("_again").isNotNull(), F.xxhash64(own)).otherwise(0))
    joined = keyed.join(gone, (key == F.col("_doc")) & (F.col("_copy") == F.col("_of")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "_parts",
        start,
        lambda s, p: F.struct(F.concat(s.out, F.substring(own, s.at + 1, F.greatest(p.char_from - s.at, F.lit(0)))).alias("out"), F.greatest(s.at, p.char_to).alias("at")),
        lambda s: F.concat(s.out, F.substring(own, s.at + 1, F.length(own))),
    )
    was = F.split(own, "\n", -1)
    emptied = lambda x, i: (F.size("_parts") > 0) & ~x.rlike("[^ \\t\\x0B\\f\\r]") & F.get(was, i).rlike("[^ \\t\\x0B\\f\\r]")
    left = F.array_join(F.filter(F.split(F.when(F.size("_parts") > 0, cut).otherwise(own), "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i) & ~emptied(x, i)), "\n")
    out = joined.withColumn("_text", F.when(F.col("_gone").isNull(), own).otherwise(left))
    kept = {c: F.col(f"`own_{c}`") for c in docs.columns}
    kept[text_col] = F.col("_text")
    if chars_col and chars_col in docs.columns:
        kept[chars_col] = F.when(F.col("_gone").isNull(), kept[chars_col]).otherwise(F.length("_text").cast(docs.schema[chars_col].dataType))
    return out.select(*[value.alias(c) for c, value in kept.items()])

"""Language identification of mixed-language text.

Words are runs of letters (at most 32 letters each). The script of a word, by
code-point ranges, leaves only the languages that use this script; each
candidate scores the word by smoothed log probabilities of its letter n-grams.
Viterbi over the words, with a penalty for every switch of language, labels
spans; a document gets the language that covers most letters.

``fit`` learns from at most ``max_rows`` labelled rows (chosen by a hash of the
id); their n-grams are hashed to a fixed number of buckets and counted by Spark,
so the model has ``languages x orders x buckets`` numbers whatever the input.
Every text is labelled as a whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties
go to the language that sorts first; rows with a null language teach nothing;
without any training row all texts are ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, share_model, slices

# numbers such as fractions and powers count as word characters, but are no letters; those beyond the first
# plane are taken out of the texts that have such characters, because they would slow the pattern down
_NUMBERS = [c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()]
WORD = re.compile(rf"[^\W\d_{re.escape(''.join(c for c in _NUMBERS if c <= chr(0xFFFF)))}]{{1,32}}")
FAR = re.compile("[\U00010000-\U0010FFFF]")
_FAR_NUMBERS = {ord(c): " " for c in _NUMBERS if c > chr(0xFFFF)}
UND = "und"
ORDERS = (1, 2, 3, 4)

# First code points of script ranges, in order, and their names.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "other"),
    (0x0900, "devanagari"),
    (0x0980, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0xFF21, "latin"),
    (0xFF66, "kana"),
    (0xFFA0, "other"),
    (0x20000, "han"),
    (0x40000, "other"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall((text.translate(_FAR_NUMBERS) if FAR.search(text) else text).lower())


def ngram_buckets(words: list[str], n: int, codes: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of bordered words, and the word of each."""
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(codes))))
    last = len(codes) - n + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = np.full(last, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + last].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = owner[:last] == owner[n - 1 : n - 1 + last]
    return (h[inside] % np.uint64(buckets)).astype(np.int64), owner[:last][inside]


def bordered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two border marks, and where each begins."""
    codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  # order x bucket x language, log probabilities
    allowed: np.ndarray  # script x language
    penalty: float = 14.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        codes, starts = bordered(words)
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for i, n in enumerate(ORDERS):
            bucket, owner = ngram_buckets(words, n, codes, starts, self.tables.shape[1])
            if len(bucket):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[first]] += np.add.reduceat(self.tables[i][bucket], first, axis=0)
        script = _SCRIPT[np.searchsorted(_FIRST, codes[starts + 1], side="right") - 1]
        allowed = self.allowed[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out[~allowed] = -1e6
        return out

    def paths(self, scores: np.ndarray, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Best language of every word, for documents laid end to end; all documents take a step together."""
        order = np.argsort(-counts, kind="stable")
        offset = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        alpha = np.zeros((len(sizes), len(self.languages)), dtype=np.float32)
        came = np.empty((len(word), len(self.languages)), dtype=np.int16)
        own = np.arange(len(self.languages), dtype=np.int16)
        for t in range(steps):
            a = active[t]
            at = offset[:a] + t
            now = alpha[:a]
            best = now.argmax(axis=1)
            top = now[np.arange(a), best] - np.float32(self.penalty)
            switch = now < top[:, None]
            came[at] = np.where(switch, best[:, None], own)
            np.maximum(now, top[:, None], out=now)
            now += scores[word[at]]
            now -= now.max(axis=1, keepdims=True)
        path = np.empty(len(word), dtype=np.int16)
        state = alpha.argmax(axis=1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            at = offset[: active[t]] + t
            path[at] = state[: active[t]]
            state[: active[t]] = came[at, state[: active[t]]]
        return path

    def label(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, score and spans (number of words and language of each) of every text."""
        per_text = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
        out = pd.DataFrame({"lang_pred": [UND] * len(texts), "score": 0.0, "span_words": [[]] * len(texts), "span_langs": [[]] * len(texts)})
        if not len(self.languages) or not counts.sum():
            return out
        word, vocabulary = pd.factorize(np.array([w for words in per_text for w in words], dtype=object))
        del per_text
        vocabulary = list(vocabulary)
        path = self.paths(self.word_scores(vocabulary), word, counts)
        letters = np.fromiter(map(len, vocabulary), dtype=np.int64, count=len(vocabulary))[word]
        doc = np.repeat(np.arange(len(texts)), counts)
        cover = np.zeros((len(texts), len(self.languages)))
        np.add.at(cover, (doc, path), letters)
        total = cover.sum(axis=1)
        has = total > 0
        names = np.array(self.languages, dtype=object)
        out.loc[has, "lang_pred"] = names[cover.argmax(axis=1)[has]]
        out.loc[has, "score"] = cover.max(axis=1)[has] / total[has]
        first = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        lengths = np.diff(np.append(first, len(path)))
        cut = np.searchsorted(doc[first], np.arange(len(texts) + 1))
        langs = names[path[first]]
        out["span_words"] = [lengths[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        out["span_langs"] = [langs[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 20_000, buckets: int = 1 << 15) -> Model:
    """Learn from labelled rows, at most about ``max_rows`` of each language, so that a rare one keeps all its rows."""
    labelled = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    share = F.lit(float(max_rows)) / F.count("*") * F.lit(float(1 << 40))
    sizes = labelled.groupBy("lang").agg(share.alias("below"))  # a row for each language, as the model has
    rows = labelled.join(F.broadcast(sizes), "lang").where(F.coalesce(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 40)) < F.col("below"), F.lit(True)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            for lang, own in frame.groupby("lang"):
                word, vocabulary = pd.factorize(np.array([w for t in own["text"] for w in words_of(t)], dtype=object))
                if not len(vocabulary):
                    continue
                weight = np.bincount(word).astype(np.float64)
                vocabulary = list(vocabulary)
                codes, starts = bordered(vocabulary)
                for n in ORDERS:
                    bucket, owner = ngram_buckets(vocabulary, n, codes, starts, buckets)
                    total = np.bincount(bucket, weights=weight[owner], minlength=buckets)
                    some = np.flatnonzero(total)
                    yield pd.DataFrame({"lang": lang, "kind": n, "bucket": some, "n": total[some].astype(np.int64)})
                script = _SCRIPT[np.searchsorted(_FIRST, codes[starts + 1], side="right") - 1]
                total = np.bincount(script, weights=weight, minlength=len(_NAMES))
                some = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "kind": 0, "bucket": some, "n": total[some].astype(np.int64)})

    counts = (
        rows.select("text", "lang")
        .mapInPandas(count, "lang string, kind int, bucket int, n long")
        .groupBy("lang", "kind", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # languages x (orders x buckets + scripts) rows at most
    )
    languages = sorted(counts["lang"].unique())
    at = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64) if len(counts) else np.zeros(0, dtype=np.int64)
    tables = np.zeros((len(ORDERS), buckets, len(languages)), dtype=np.float32)
    for i, n in enumerate(ORDERS):
        own = (counts["kind"] == n).to_numpy()
        table = np.full((buckets, len(languages)), 0.5)
        table[counts["bucket"].to_numpy()[own], at[own]] += counts["n"].to_numpy()[own]
        tables[i] = np.log(table / table.sum(axis=0, keepdims=True)) if len(languages) else 0
    seen = np.zeros((len(_NAMES), len(languages)))
    own = (counts["kind"] == 0).to_numpy()
    seen[counts["bucket"].to_numpy()[own].astype(int), at[own]] = counts["n"].to_numpy()[own]
    allowed = seen >= np.maximum(0.001 * seen.sum(axis=0, keepdims=True), 1)
    return Model(languages, tables, allowed)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The given rows with ``lang_pred``, ``score``, ``span_words`` and ``span_langs``; clashing columns are replaced."""
    load = share_model(docs.sparkSession, model)
    new = ["lang_pred", "score", "span_words", "span_langs"]
    kept = [c for c in docs.columns if c not in new]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        for frame in slices(frames, text_col, 3 << 20):
            labels = own.label(frame[text_col].tolist())
            yield pd.concat([frame, labels], axis=1)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return bound_batches(docs).select(*[F.col(f"`{c}`") for c in kept]).mapInPandas(run, f"{fields}, lang_pred string, score double, span_words array<int>, span_langs array<string>")

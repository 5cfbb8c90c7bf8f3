"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the mean of hashed embeddings of the word and of its first
three to six letters. Filters over one, two and three neighbouring words run over
the whole text, each filter keeps its largest response (max pooling), and a
logistic layer turns these into a logit. Every distinct word is looked up once
per batch: a filter of width ``k`` is the sum of ``k`` per-word tables, so a text
costs a few gathers per word and memory stays flat for texts of any length.

Thresholds are calibrated by language: texts are sorted into languages by their
own function words (never by a language column), and each language's threshold is
set on a calibration part of the training rows, drawn towards the common one where
there are few. The score is ``sigmoid(slope * (logit - threshold))``, so 0.5 is
the calibrated threshold.

``fit`` learns from all labelled rows, in shards whose models are averaged after every round; the driver
holds the model and counts of logits, never rows.

Edge cases: null and empty texts are texts without words and get a score of their
own (all filters at their floor); rows with a null label teach nothing; without
rows of both classes all scores are the share of the class there is (0.5 with no
rows at all).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, free_shuffles, release, share_model, slices, stage, sum_over_tasks

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
FLOOR = -1.0

# Frequent function words by language; they only choose a threshold.
FUNCTION_WORDS = {
    "de": "der die und den von zu das mit ist im für auf dem nicht eine",
    "en": "the of and to in is that for it was with on as are by this",
    "es": "de la que el en los se del las por un para con no una su",
    "fr": "le la les des et en un du une que est pour qui dans sur pas au",
}
_LANGS = sorted(FUNCTION_WORDS)
_VOTES: dict[str, list[int]] = {}
for _i, _l in enumerate(_LANGS):
    for _w in FUNCTION_WORDS[_l].split():
        _VOTES.setdefault(_w, []).append(_i)


def word_buckets(vocabulary: list[str]) -> np.ndarray:
    """Embedding buckets of each word, one row per word; ``BUCKETS`` where a word is too short for a prefix."""
    out = np.full((len(vocabulary), 1 + len(PREFIXES)), BUCKETS, dtype=np.int64)
    for i, w in enumerate(vocabulary):
        out[i, 0] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        for j, n in enumerate(PREFIXES):
            if len(w) < n:
                break
            out[i, 1 + j] = zlib.crc32(("^" + w[:n]).encode("utf-8", "replace")) % BUCKETS
    return out


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of all texts end to end (as indices), the distinct words, and the number of words of each text."""
    per_text = [WORD.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
    word, vocabulary = pd.factorize(np.array([w for ws in per_text for w in ws], dtype=object))
    return word, list(vocabulary), counts


def guess_languages(word: np.ndarray, vocabulary: list[str], counts: np.ndarray) -> np.ndarray:
    """Index of the language whose function words occur most, or one past the last for none."""
    votes = np.zeros((len(vocabulary) + 1, len(_LANGS)), dtype=np.int64)
    for i, w in enumerate(vocabulary):
        for j in _VOTES.get(w, ()):
            votes[i, j] = 1
    doc = np.repeat(np.arange(len(counts)), counts)
    got = np.stack([np.bincount(doc, weights=votes[word, j], minlength=len(counts)) for j in range(len(_LANGS))], axis=1) if len(word) else np.zeros((len(counts), len(_LANGS)))
    return np.where(got.max(axis=1) > 0, got.argmax(axis=1), len(_LANGS))


@dataclass
class Model:
    embedding: np.ndarray  # bucket x dim
    filters: list[np.ndarray]  # by width: width x dim x filter
    bias: np.ndarray  # all filters
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGS) + 1))
    slope: float = 1.0

    def pooled(self, word: np.ndarray, buckets: np.ndarray, counts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every text, and the word at which it begins (-1: nowhere)."""
        n, total = len(counts), len(WIDTHS) * FILTERS
        out, where = np.full((n, total), FLOOR, dtype=np.float32), np.full((n, total), -1, dtype=np.int64)
        if not len(word):
            return out, where
        vectors = word_vectors(self.embedding, buckets)
        first = np.cumsum(counts) - counts
        for i, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            has = counts >= width
            if not has.any():
                continue
            tables = [(vectors @ f[k]).astype(np.float32) for k in range(width)]
            length = len(word) - width + 1
            response = tables[0][word[:length]]
            for k in range(1, width):
                response += tables[k][word[k : k + length]]
            # windows that would run into the next text do not count
            begin, end = first[has], first[has] + counts[has] - width + 1
            cuts = np.stack([begin, end], axis=1).ravel()
            span = slice(i * FILTERS, (i + 1) * FILTERS)
            if cuts[-1] == length:
                cuts = cuts[:-1]
            top = np.maximum.reduceat(response, cuts, axis=0)[::2] + self.bias[span]
            rows = np.flatnonzero(has)
            better = top > FLOOR
            out[rows, span] = np.where(better, top, FLOOR)
            if places:
                for r, b, e in zip(rows, begin, end, strict=True):
                    where[r, span] = np.where(out[r, span] > FLOOR, b + response[b:e].argmax(axis=0), -1)
        return out, where

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the languages that choose the thresholds."""
        word, vocabulary, counts = lay_out(texts)
        pooled, _ = self.pooled(word, word_buckets(vocabulary), counts)
        return pooled @ self.weights + self.offset, guess_languages(word, vocabulary, counts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z, lang = self.logits(texts)
        return sigmoid(self.slope * (z - self.thresholds[lang]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_vectors(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Mean of the embeddings; the row past the last bucket is zero and does not count."""
    return embedding[buckets].sum(axis=1) / (buckets < BUCKETS).sum(axis=1)[:, None].astype(np.float32)


def bucket_counts(word: np.ndarray, buckets: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the texts in which it occurs, and those of class 1 among them."""
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.unique((doc[:, None] * (BUCKETS + 1) + buckets[word]).ravel()) if len(word) else np.zeros(0, dtype=np.int64)
    doc, bucket = at // (BUCKETS + 1), at % (BUCKETS + 1)
    return np.bincount(bucket, minlength=BUCKETS + 1).astype(np.float64), np.bincount(bucket, weights=labels[doc], minlength=BUCKETS + 1)


def association(n: np.ndarray, positive: np.ndarray, rows: float, positives: float) -> np.ndarray:
    """For each bucket, in how many more texts of class 1 it occurs than by chance, in standard deviations (-4 to 4)."""
    share = positives / rows if rows else 0.5
    out = np.clip((positive - n * share) / np.sqrt(n * share * (1 - share) + 1), -4, 4)
    out[BUCKETS] = 0
    return out


def begin(lean: np.ndarray, seed: int = 1) -> Model:
    """The model before training: the first embedding dimension is ``lean``, the first half of the filters of each width look at it."""
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * FILTERS
    embedding = np.vstack([rng.normal(0, 0.05, (BUCKETS, DIM)), np.zeros((1, DIM))])
    embedding[:, 0] = lean
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = 1
    return Model(
        embedding.astype(np.float32),
        [f.astype(np.float32) for f in filters],
        np.zeros(n_filters, dtype=np.float32),
        np.abs(rng.normal(0.3, 0.1, n_filters)).astype(np.float32),
        -1.0,
    )


def take(word: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The words of some of the texts, end to end."""
    ends = np.cumsum(sizes)
    return np.concatenate([word[ends[r] - sizes[r] : ends[r]] for r in rows]) if len(rows) else word[:0]


def descend(model: Model, all_words: np.ndarray, all_buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, balance: np.ndarray, passes: int, rate: float = 0.01, batch: int = 64, seed: int = 1) -> None:
    """Adam on the logistic loss, in place; a max-pooled filter passes its gradient to the one window that it came from."""
    rng = np.random.default_rng(seed)
    params = [model.embedding, *model.filters, model.bias, model.weights]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    done = 0
    order = np.arange(len(sizes))
    first = np.cumsum(sizes) - sizes
    for _ in range(passes):
        rng.shuffle(order)
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            counts = sizes[rows]
            names, word = np.unique(np.concatenate([all_words[first[r] : first[r] + sizes[r]] for r in rows]), return_inverse=True)
            buckets = all_buckets[names]
            pooled, where = model.pooled(word, buckets, counts, places=True)
            p = sigmoid(pooled @ model.weights + model.offset)
            d = ((p - labels[rows]) * balance[rows] / len(rows)).astype(np.float32)
            g_weights = pooled.T @ d + 1e-3 * model.weights
            back = d[:, None] * model.weights[None, :]
            back[where < 0] = 0
            g_bias = back.sum(axis=0)
            g_filters = [np.zeros_like(f) for f in model.filters]
            g_embedding = np.zeros_like(model.embedding)
            if len(names):
                vectors = word_vectors(model.embedding, buckets)
                g_vectors = np.zeros_like(vectors)
                for i, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                    for j in range(FILTERS):
                        c = i * FILTERS + j
                        use = where[:, c] >= 0
                        for k in range(width):
                            at = word[where[use, c] + k]
                            g_filters[i][k, :, j] += back[use, c] @ vectors[at]
                            np.add.at(g_vectors, at, back[use, c][:, None] * f[k, :, j][None, :])
                touched = np.flatnonzero(g_vectors.any(axis=1))
                own = buckets[touched]
                share = g_vectors[touched] / (own < BUCKETS).sum(axis=1)[:, None]
                np.add.at(g_embedding, own.ravel(), np.repeat(share, own.shape[1], axis=0))
                g_embedding[BUCKETS] = 0
            done += 1
            for q, g, (m, v) in zip(params, [g_embedding, *g_filters, g_bias, g_weights], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-7)
            model.offset -= rate * float(d.sum()) * 5


def train(texts: list[str | None], labels: np.ndarray, steps: int = 250, rate: float = 0.01, batch: int = 64, seed: int = 1) -> Model:
    """Train on texts at hand, in as many whole passes as give that many steps.

    The first embedding dimension starts as the association of a bucket with the label; everything is trained from there.
    """
    word, vocabulary, sizes = lay_out(texts)
    buckets = word_buckets(vocabulary)
    model = begin(association(*bucket_counts(word, buckets, sizes, labels), len(labels), float(labels.sum())) / 2, seed)
    if len(texts):
        descend(model, word, buckets, sizes, labels, balance_of(labels, labels.mean()), -(-steps * batch // len(texts)), rate, batch, seed)
    return model


def balance_of(labels: np.ndarray, share: float) -> np.ndarray:
    """Weights under which both classes count the same, where ``share`` of all rows are of class 1."""
    return np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


def best_threshold(z: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The cut with the largest balanced accuracy, the middle of the widest such gap; the classes are counted at rising logits ``z``."""
    seen = (positive + negative) > 0
    z, positive, negative = z[seen], positive[seen], negative[seen]
    pos, neg = max(positive.sum(), 1), max(negative.sum(), 1)
    below_pos, below_neg = np.concatenate([[0], np.cumsum(positive)]), np.concatenate([[0], np.cumsum(negative)])
    quality = (pos - below_pos) / pos + below_neg / neg
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    top = np.flatnonzero(quality >= quality.max() - 1e-9)
    gaps = edges[top + 1] - edges[top]
    k = top[gaps.argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


# logits are counted in steps of 1 / 128 from -32 to 32
STEPS, REACH = 128, 32
_LOGITS = (np.arange(2 * REACH * STEPS) + 0.5) / STEPS - REACH


def logit_counts(z: np.ndarray, lang: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows by language, class and logit."""
    shape = (len(_LANGS) + 1, 2, len(_LOGITS))
    at = np.clip(((z + REACH) * STEPS).astype(np.int64), 0, shape[2] - 1)
    return np.bincount((lang * 2 + labels.astype(np.int64)) * shape[2] + at, minlength=math.prod(shape)).reshape(shape).astype(np.float64)


def calibrate(model: Model, counts: np.ndarray, prior: float = 40.0) -> None:
    """Thresholds and slope from the ``logit_counts`` of all rows that are kept for it."""
    common = best_threshold(_LOGITS, counts[:, 1].sum(axis=0), counts[:, 0].sum(axis=0))
    model.thresholds[:] = common
    for i in range(len(_LANGS)):
        few = counts[i].sum(axis=1).min()
        if few:
            model.thresholds[i] = (few * best_threshold(_LOGITS, counts[i, 1], counts[i, 0]) + prior * common) / (few + prior)
    centred = _LOGITS[None, :] - model.thresholds[:, None]
    slopes = np.geomspace(0.1, 5, 30)
    losses = [sum((counts[:, c] * np.log1p(np.exp(-np.clip(s * sign * centred, -30, 30)))).sum() for c, sign in ((1, 1), (0, -1))) for s in slopes]
    model.slope = float(slopes[int(np.argmin(losses))])


# rows, and characters, that a task learns from in one go before what was learnt is averaged
SHARD_ROWS, SHARD_CHARS = 4096, 16 << 20
ROUNDS = 4
_KINDS = {"word": np.int32, "bucket": np.int32, "size": np.int64, "y": np.int8, "held": np.bool_, "lang": np.int8}


def shards(rows: DataFrame) -> DataFrame:
    """``(id, text, y, held)`` as rows of at most ``SHARD_ROWS`` texts, in numbers: what ``lay_out``, ``word_buckets`` and ``guess_languages`` give."""

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        own = pd.concat(held).sort_values("id", kind="stable")
        word, vocabulary, counts = lay_out(own["text"].tolist())
        parts = (word, word_buckets(vocabulary), counts, own["y"].to_numpy(), own["held"].to_numpy(), guess_languages(word, vocabulary, counts))
        return pd.DataFrame({k: [np.ascontiguousarray(p, dtype=t).tobytes()] for (k, t), p in zip(_KINDS.items(), parts, strict=True)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, chars = [], 0, 0
        for frame in slices(frames, "text"):
            for at in range(0, len(frame), SHARD_ROWS // 4):
                piece = frame.iloc[at : at + SHARD_ROWS // 4]
                long = sum(len(t) if t else 0 for t in piece["text"])
                if held and (n + len(piece) > SHARD_ROWS or chars + long > SHARD_CHARS):
                    yield packed(held)
                    held, n, chars = [], 0, 0
                held.append(piece)
                n, chars = n + len(piece), chars + long
        if held:
            yield packed(held)

    return bound_batches(rows).mapInPandas(run, ", ".join(f"{k} binary" for k in _KINDS))


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    for frame in frames:
        for row in frame[list(_KINDS)].itertuples(index=False, name=None):
            parts = [np.frombuffer(x, dtype=t) for x, t in zip(row, _KINDS.values(), strict=True)]
            parts[0], parts[1] = parts[0].astype(np.int64), parts[1].reshape(-1, 1 + len(PREFIXES)).astype(np.int64)
            yield parts


def count_buckets(packed: DataFrame, apart: bool) -> np.ndarray:
    """``bucket_counts`` of all rows that are learnt from."""

    def run(frames: Iterator[pd.DataFrame]) -> np.ndarray | None:
        total = None
        for word, buckets, sizes, y, held, _ in _unpacked(frames):
            rows = np.flatnonzero(~held) if apart else np.arange(len(y))
            own = np.stack(bucket_counts(take(word, sizes, rows), buckets, sizes[rows], y[rows].astype(np.float64)))
            total = own if total is None else total + own
        return None if total is None else total.ravel()

    return sum_over_tasks(packed, run, 2 * (BUCKETS + 1)).reshape(2, -1)


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([p.ravel() for p in (model.embedding, *model.filters, model.bias, model.weights)] + [[model.offset]]).astype(np.float64)


def _set(model: Model, flat: np.ndarray) -> None:
    at = 0
    for p in (model.embedding, *model.filters, model.bias, model.weights):
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    model.offset = float(flat[at])


def one_round(packed: DataFrame, model: Model, passes: int, share: float, apart: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the model on the rows that are kept for the calibration, counted; and what all shards learn from it, on average.

    Every shard goes on from the same model by itself, for ``passes`` over its rows.
    """
    load = share_model(packed.sparkSession, model)
    n, start = (len(_LANGS) + 1) * 2 * len(_LOGITS), _flat(model)

    def run(frames: Iterator[pd.DataFrame]) -> np.ndarray | None:
        total = None
        for word, buckets, sizes, y, held, lang in _unpacked(frames):
            own = load()
            total = np.zeros(n + 1 + len(start)) if total is None else total
            rows = np.flatnonzero(held) if apart else np.arange(len(y))
            # a bounded number of words at a time
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) >> 18)) + 1):
                if len(part):
                    z = own.pooled(take(word, sizes, part), buckets, sizes[part])[0] @ own.weights + own.offset
                    total[:n] += logit_counts(z, lang[part].astype(np.int64), y[part]).ravel()
            rows = np.flatnonzero(~held) if apart else rows
            if passes and len(rows):
                labels = y[rows].astype(np.float64)
                descend(own, take(word, sizes, rows), buckets, sizes[rows], labels, balance_of(labels, share), passes, seed=seed)
                total[n] += len(rows)
                total[n + 1 :] += len(rows) * (_flat(own) - start)
        return total

    total = sum_over_tasks(packed, run, n + 1 + len(start))
    return total[:n].reshape(len(_LANGS) + 1, 2, -1), total[n + 1 :] / max(total[n], 1)


def balanced_loss(counts: np.ndarray) -> float:
    """Logistic loss, both classes counting the same."""
    loss = [np.log1p(np.exp(-np.clip(sign * _LOGITS, -30, 30))) for sign in (-1, 1)]
    return float(sum((counts[:, c].sum(axis=0) * loss[c]).sum() / max(counts[:, c].sum(), 1) for c in (0, 1)))


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", steps: int = 250, batch: int = 64) -> Model:
    """Train on all labelled rows but a quarter, on which the model is calibrated.

    The rows are laid out once, in shards. Every round gives the model to all shards, each goes on from it by itself, and
    what they learn is averaged by their rows. The model with the smallest loss on the calibration rows is kept.
    """
    own = rows.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    own = own.withColumn("held", F.coalesce(F.crc32(F.concat(F.lit("part"), "id")) % 4 == 0, F.lit(False)))
    sizes = {(r["held"], r["y"]): r["count"] for r in own.groupBy("held", "y").count().collect()}
    by_class = [sizes.get((False, y), 0) + sizes.get((True, y), 0) for y in (0, 1)]
    if not all(by_class):
        share = by_class[1] / sum(by_class) if sum(by_class) else 0.5
        model = begin(np.zeros(BUCKETS + 1))
        model.weights[:] = 0
        model.offset, model.slope = float(np.log((share + 1e-6) / (1 - share + 1e-6))), 1.0
        return model
    # too few rows to keep some apart
    apart = all(sizes.get((held, y), 0) for held in (False, True) for y in (0, 1))
    learnt = [sizes[(False, y)] for y in (0, 1)] if apart else by_class
    packed = stage(shards(own), "labelled-shards")
    free_shuffles(rows.sparkSession)
    model = begin(association(*count_buckets(packed, apart), sum(learnt), learnt[1]) / 2)
    passes = math.ceil(steps * batch / (ROUNDS * sum(learnt)))
    kept, least = None, np.inf
    for turn in range(ROUNDS + 1):
        counts, learnt_now = one_round(packed, model, passes if turn < ROUNDS else 0, learnt[1] / sum(learnt), apart, turn)
        loss = balanced_loss(counts)
        if loss < least:
            kept, least = (_flat(model), counts), loss
        _set(model, _flat(model) + learnt_now)
        free_shuffles(rows.sparkSession)
    release(packed)
    _set(model, kept[0])
    calibrate(model, kept[1])
    return model

"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector (a few +1 and -1, fixed by its
hash). A word's vector is the sum of the index vectors of its neighbours over
the whole corpus, so words used alike point alike; words are hashed to a fixed
number of buckets, which makes the vectors one table of ``buckets x dim`` sums
that Spark adds up task by task. Words and runs of punctuation are tokens of
their own, and upper-case words also leave a mark, so that a token's use shows
how the text is written.

A document is the mean and the spread of its tokens' vectors, with a few
proportions (length, distinct tokens, the same token again within the last few).
A two-layer numpy network turns this into a logit, and a temperature fitted on a
part of the training rows that the network has not seen calibrates it.

The word vectors cover all documents and use no labels; ``fit`` learns labels from
at most ``max_rows`` labelled rows of each class.

Edge cases: null and empty texts have the zero vector and get the network's score
for it; rows with a null label teach nothing; without rows of both classes all
scores are the share of the class there is (0.5 with no rows at all).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, bounded_sample, slices

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 13
DIM = 32
NONZERO = 4
BLOCK = 64
PROPORTIONS = 6


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def index_vectors() -> np.ndarray:
    """Random index vectors of all buckets; the same in every task."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32)
    np.put_along_axis(out, places, signs, axis=1)
    return out


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens end to end: index of the distinct token, its bucket, whether it is upper case; tokens per text."""
    per_text = [TOKEN.findall(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
    token, vocabulary = pd.factorize(np.array([w for ws in per_text for w in ws], dtype=object))
    buckets = np.fromiter((bucket_of(w.lower()) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in vocabulary), dtype=bool, count=len(vocabulary))
    return token.astype(np.int64), buckets, upper, counts


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sums of the neighbours' index vectors for every bucket, over all documents.

    Each task adds its texts into one table and hands it over in blocks, which are added block by
    block. The result has a fixed size.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, DIM), dtype=np.float64)
        index = index_vectors()
        used = False
        for frame in slices(frames, "text"):
            token, buckets, _, counts = lay_out(frame["text"].tolist())
            if not len(token):
                continue
            used = True
            here = buckets[token]
            doc = np.repeat(np.arange(len(counts)), counts)
            same = doc[1:] == doc[:-1]
            keys, times = np.unique(here[:-1][same] * BUCKETS + here[1:][same], return_counts=True)
            left, right = keys // BUCKETS, keys % BUCKETS
            for d in range(DIM):
                total[:, d] += np.bincount(left, weights=times * index[right, d], minlength=BUCKETS)
                total[:, d] += np.bincount(right, weights=times * index[left, d], minlength=BUCKETS)
        if used:
            for b in range(0, BUCKETS, BLOCK):
                yield pd.DataFrame({"block": [b], "sums": [total[b : b + BLOCK].ravel().astype(np.float32)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, sums in zip(frame["block"], frame["sums"], strict=True):
                held[block] = held.get(block, 0) + np.asarray(sums, dtype=np.float64)
        if held:
            yield pd.DataFrame({"block": list(held), "sums": list(held.values())})

    blocks = (
        bound_batches(docs).select(F.col(text_col).alias("text"))
        .mapInPandas(count, "block int, sums array<float>")
        .repartition("block")
        .mapInPandas(add, "block int, sums array<double>")
        .toPandas()  # buckets x dim numbers
    )
    out = np.zeros((BUCKETS, DIM))
    for block, sums in zip(blocks["block"], blocks["sums"], strict=True):
        out[block : block + BLOCK] = np.asarray(sums).reshape(-1, DIM)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums without the direction that all words share, at unit length."""
    sized = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    centred = sized - sized[np.abs(sums).sum(axis=1) > 0].mean(axis=0) if np.abs(sums).sum() else sized
    return (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its token vectors, and proportions."""
    token, buckets, upper, counts = lay_out(texts)
    out = np.zeros((len(texts), 2 * DIM + PROPORTIONS))
    out[:, -1] = 1
    if not len(token):
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    has = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[has]
    n = counts[has][:, None]
    own = vectors[buckets[token]]
    mean = np.add.reduceat(own, first, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(own * own, first, axis=0) / n - mean * mean, 0))
    again = np.zeros(len(token))
    for back in (1, 2, 3):
        again[back:] = np.maximum(again[back:], (token[back:] == token[:-back]) & (doc[back:] == doc[:-back]))
    shouted = upper[token]
    pairs = np.unique(doc * (int(token.max()) + 1) + token)
    distinct = np.bincount(pairs // (int(token.max()) + 1), minlength=len(counts))[has]
    characters = np.array([len(t) if t else 0 for t in texts])[has]
    proportions = [np.log1p(counts[has]), distinct / np.sqrt(counts[has]), np.add.reduceat(again, first) / n[:, 0], np.add.reduceat(shouted.astype(float), first) / n[:, 0], characters / counts[has]]
    out[has] = np.column_stack([mean, spread, *proportions, np.zeros(len(has))])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pool(texts, self.vectors)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.005, batch: int = 64, seed: int = 1) -> Model:
    """Adam on the logistic loss of a network with one hidden layer."""
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    m = Model(vectors, centre, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - centre) / scale
    params = [m.first, m.first_bias, m.second]
    offset = np.zeros(1)
    params.append(offset)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    order = np.arange(len(y))
    for _ in range(epochs):
        rng.shuffle(order)
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            pre = z[rows] @ m.first + m.first_bias
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m.second + offset[0], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * m.second[None, :] * (pre > 0)
            grads = [z[rows].T @ back + 1e-4 * m.first, back.sum(axis=0), h.T @ d + 1e-4 * m.second, np.array([d.sum()])]
            step += 1
            for q, g, (a, v) in zip(params, grads, moments, strict=True):
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    m.second_bias = float(offset[0])
    return m


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature with the smallest loss on rows that the network has not learnt from."""
    z = model.logits(x)
    temperatures = np.geomspace(0.25, 8, 60)
    losses = [np.mean(np.log1p(np.exp(-np.clip(np.where(y == 1, z, -z) / t, -30, 30)))) for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(losses))])


def fit(docs: DataFrame, rows: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 5_000) -> Model:
    """Word vectors from all ``docs``; labels from ``rows``, at most about ``max_rows`` of each class."""
    vectors = word_vectors(context_sums(docs, text_col))
    classes = [rows.where(F.col(label_col) == c) for c in (0, 1)]
    sizes = [c.count() for c in classes]
    taken = bounded_sample(classes[0], id_col, max_rows).unionByName(bounded_sample(classes[1], id_col, max_rows))
    taken = taken.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "x": list(pool(frame["text"].tolist(), vectors))})

    found = taken.mapInPandas(features, "id string, y int, x array<double>").toPandas().sort_values("id", kind="stable").reset_index(drop=True)
    y = found["y"].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        width = 2 * DIM + PROPORTIONS
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    x = np.stack(found["x"].to_numpy())
    part = np.array([zlib.crc32(b"part" + i.encode()) % 5 for i in found["id"]])
    learn = part != 0
    if not 0 < y[learn].mean() < 1 or learn.all():
        learn = np.ones(len(y), dtype=bool)
    model = train(x[learn], y[learn], vectors)
    held = ~learn if (~learn).any() else learn
    calibrate(model, x[held], y[held])
    # the classes were sampled at different rates; probabilities hold for the rows as they are
    shares = np.array([(y == c).sum() / max(sizes[c], 1) for c in (0, 1)])
    model.second_bias += model.temperature * float(np.log(shares[0] / shares[1]))
    return model

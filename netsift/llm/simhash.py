"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint holds the majority of each bit over the XXH64 hashes of all its
word shingles. Fingerprints link at ``radius`` or fewer differing bits. Two of them do
so exactly if some 64-bit value lies within half the radius of both, so every distinct
fingerprint emits all values within half the radius (2,081 for a radius of 4), equal
values meet, and the fingerprints behind them are verified and linked. All fingerprints
that meet on one value are within the radius of each other, so the smallest of them is
linked with the rest and no pairs are written.

Values are dealt to passes and buckets by parities of their bits: the parities of a
fingerprint and of the flipped bits add up, so they say which of a fingerprint's values lie
in a bucket. The fingerprint travels there once, packed with others, and its values are made
on arrival: at most eight bytes a value, fewer where several lie in one bucket. At most 2,081
fingerprints can meet on a value, whatever the data.

Edge cases: null, empty and blank texts have fingerprint zero and are linked as any other;
equal fingerprints are one node; repeated rows are repeated in the result; rows without an
id link nothing and have component null; an empty table gives no rows. Ids may be of any
type that can be ordered.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import free_shuffles, release, slices, stage
from netsift.llm.components import connected_components
from netsift.llm.minhash import words

#: shares of the values that are shuffled one after another, so that one share is on disk at a time
PASSES = 4
#: values that meet in one bucket, about
BUCKET_VALUES = 1 << 22
#: fingerprints that are packed at once
CHUNK = 4096


def shingle_digests(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; fewer words are one run."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate((len(w) + 1 for w in tokens)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    places = zip(starts, ends[shingle - 1 :], strict=False) if len(tokens) >= shingle else [(0, ends[-1])]
    return np.array([digest(joined[s : e - 1], seed) for s, e in places], dtype=np.uint64)


def majority(digests: np.ndarray) -> int:
    """The bits that are set in over half of the digests."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(digests), 1 << 16):
        part = digests[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(digests), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fp long)`` of every ``(id, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            found = [majority(shingle_digests(t, shingle, seed)) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "fp": np.array(found, dtype=np.uint64).view(np.int64)})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInPandas(run, f"id {kind}, fp long")


def ball(reach: int) -> np.ndarray:
    """All 64-bit values with at most ``reach`` bits set."""
    bits = [1 << k for k in range(64)]
    return np.array([sum(c) for k in range(reach + 1) for c in itertools.combinations(bits, k)], dtype=np.uint64)


def parities(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parities of fixed random halves of each value's bits, as one number; of x ^ y it is that of x ^ that of y."""
    checks = np.random.default_rng(64).integers(1, 1 << 63, 48, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(values), dtype=np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(values & checks[k]) & 1).astype(np.int64) << k
    return out


def _emit(nodes: DataFrame, reach: int, turn: int, pass_bits: int, bucket_bits: int) -> DataFrame:
    """``(bucket, packed)``: for every bucket of one pass, the fingerprints with values in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = parities(ball(reach), pass_bits + bucket_bits)
        low = (1 << pass_bits) - 1
        for frame in frames:
            for k in range(0, len(frame), CHUNK):
                x = frame["fp"].to_numpy()[k : k + CHUNK].view(np.uint64)
                names = parities(x, pass_bits + bucket_bits)
                sources, buckets = [], []
                for q in range(low + 1):
                    some, flips = np.flatnonzero((names & low) == q), np.unique(own[(own & low) == (q ^ turn)] >> pass_bits)
                    sources.append(np.repeat(x[some], len(flips)))
                    buckets.append(((names[some, None] >> pass_bits) ^ flips).ravel())
                source, bucket = np.concatenate(sources), np.concatenate(buckets).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                source, bucket = source[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                packed = [part.tobytes() for part in np.split(source, cuts)] if len(source) else []
                yield pd.DataFrame({"bucket": bucket[np.append(0, cuts)] if packed else bucket, "packed": packed})

    return nodes.mapInPandas(run, "bucket int, packed binary")


def meet(sources: np.ndarray, name: int, bits: int, reach: int, radius: int) -> np.ndarray:
    """Links of one bucket: between the smallest fingerprint with a value and each other one with it."""
    flips = ball(reach)
    own = parities(flips, bits)
    order = np.argsort(own, kind="stable")
    flips, own = flips[order], own[order]
    wanted = parities(sources, bits) ^ name
    low, high = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
    n = high - low
    at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    source = np.repeat(sources, n)
    value = source ^ flips[at]
    ordered = np.sort(value)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty((0, 2), dtype=np.int64)
    hit = np.isin(value, twice)
    value, source = value[hit], source[hit]
    order = np.lexsort((source, value))
    value, source = value[order], source[order]
    first = np.append(True, value[1:] != value[:-1])
    least = source[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
    near = (least != source) & (np.bitwise_count(least ^ source) <= radius)
    return np.unique(np.stack([least[near].view(np.int64), source[near].view(np.int64)], axis=1), axis=0)


def _collide(dealt: DataFrame, reach: int, radius: int, turn: int, pass_bits: int, bucket_bits: int) -> DataFrame:
    """Links ``(a, b)`` of each bucket; rows come sorted by bucket."""

    def links(bucket: int, packed: list[bytes]) -> pd.DataFrame:
        sources = np.frombuffer(b"".join(packed), dtype=np.uint64)
        return pd.DataFrame(meet(sources, (int(bucket) << pass_bits) | turn, pass_bits + bucket_bits, reach, radius), columns=["a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, []
        for frame in frames:
            for name, packed in zip(frame["bucket"], frame["packed"], strict=True):
                if name != bucket and held:
                    yield links(bucket, held)
                    held = []
                bucket = name
                held.append(packed)
        if held:
            yield links(bucket, held)

    return dealt.mapInPandas(run, "a long, b long")


def ball_links(nodes: DataFrame, radius: int = 4, passes: int = PASSES) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp)`` whose components are those of all pairs within the radius."""
    if radius % 2 or passes & (passes - 1):
        raise ValueError("the radius must be even and the number of passes a power of two")
    spark, n = nodes.sparkSession, nodes.count()
    slots = spark.sparkContext.defaultParallelism
    reach, pass_bits = radius // 2, passes.bit_length() - 1
    values = n * len(ball(reach)) / passes
    bucket_bits = min(24, max(math.ceil(math.log2(max(1, values / BUCKET_VALUES))), math.ceil(math.log2(4 * slots)) if n > CHUNK else 2))
    nodes = stage(nodes.select("fp").repartition(max(1, math.ceil(n / 65536), min(2 * slots, math.ceil(n / 256)))), "fingerprints")
    links = None
    for turn in range(passes):
        dealt = _emit(nodes, reach, turn, pass_bits, bucket_bits).repartition(1 << bucket_bits, "bucket").sortWithinPartitions("bucket")
        found = stage(_collide(dealt, reach, radius, turn, pass_bits, bucket_bits).distinct(), "ball-links")
        links = found if links is None else links.union(found)
        free_shuffles(spark)
    release(nodes)
    return links


def near_fingerprints(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row; the component is the smallest id that links reach."""
    kind = docs.schema[id_col].dataType.simpleString()
    marked = stage(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, seed), "fingerprinted")
    nodes = stage(marked.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    groups = stage(connected_components(ball_links(nodes, radius)), "fingerprint-groups")
    named = nodes.join(groups, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = stage(named.join(least, "component").select("fp", "component_id"), "fingerprint-labels")
    release(nodes, groups)
    out = marked.join(labels, "fp", "left")
    own = F.when(F.col("id").isNotNull(), F.col("component_id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))

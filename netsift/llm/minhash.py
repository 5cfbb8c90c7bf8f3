"""MinHash signatures of word-shingle sets, and the exact groups that follow from them.

Signatures are minima of many universal hash functions (multiply-shift on 64-bit
shingle hashes). Equal bands of minima make candidates, the share of equal minima
drops those that are far below the threshold, and the full sets decide.

``similar_groups`` gives the components of *all* confirmed links without writing
all pairs of a bucket: first every bucket compares its members with one leader,
links found so far merge members into components, and only buckets that still
hold more than one component stay open. What is left there is compared in blocks,
members of smaller components against all others, by signature and then by full
set inside the task; only links leave it. Where that would be too much work,
further rounds with other leaders come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import free_shuffles, release, stage
from netsift.llm.components import connected_components

#: band keys that meet in one bucket, about, and bits of the table of repeated keys
BUCKET_KEYS, KEY_BITS = 1 << 21, 1 << 25
LEADER_ROUNDS = 5
#: signature comparisons per item at which another leader is tried before the blocks
MOST_COMPARISONS = 2000
BLOCK = 512
LEFT_BLOCK = 4096


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(tokens: list[bytes], n: int) -> set[bytes]:
    """Distinct runs of ``n`` words; fewer words are one run; no words, no run."""
    if len(tokens) <= n:
        return {b" ".join(tokens)} if tokens else set()
    return {b" ".join(x) for x in zip(*(tokens[k:] for k in range(n)), strict=False)}


def enough(a: set, b: set, num: int, den: int) -> bool:
    """Whether the Jaccard similarity is at least ``num / den``, in whole numbers."""
    common = len(a & b)
    return bool(a) and den * common >= num * (len(a) + len(b) - common)


def shingle_hashes(texts: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts end to end, and the number of each text's (not yet distinct)."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), dtype=np.uint64, count=int(counts.sum()))
    places = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    total = int(places.sum())
    at = np.arange(total) - np.repeat(np.cumsum(places) - places, places) + np.repeat(first, places)
    short = np.repeat(counts < n, places)
    h = np.zeros(total, dtype=np.uint64)
    padded = np.append(flat, np.zeros(n, dtype=np.uint64))
    left = np.repeat(counts, places)
    for k in range(n):
        own = padded[at + k]
        own[short & (left <= k)] = 0
        h = (h ^ own) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h, places


@dataclass(frozen=True)
class Bands:
    """``bands`` of ``rows`` minima each."""

    bands: int
    rows: int

    @classmethod
    def tuned(cls, similarity: float, rows: int, miss: float) -> Bands:
        """As many bands as make a pair at the threshold be missed with at most the given probability."""
        return cls(math.ceil(math.log(miss) / math.log(1 - similarity**rows)), rows)

    @property
    def total(self) -> int:
        return self.bands * self.rows

    def sign(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and one byte of each minimum, for texts with at least one shingle."""
        rng = np.random.default_rng(20_240_229)
        factors = rng.integers(1, 1 << 63, self.total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, self.total, dtype=np.uint64)
        first = np.cumsum(places) - places
        minima = np.empty((len(places), self.total), dtype=np.uint64)
        for i in range(self.total):
            minima[:, i] = np.minimum.reduceat((hashes * factors[i] + shifts[i]) >> np.uint64(24), first)
        keys = np.empty((len(places), self.bands), dtype=np.uint64)
        for b in range(self.bands):
            key = np.full(len(places), b + 1, dtype=np.uint64)
            for r in range(self.rows):
                key = (key ^ minima[:, b * self.rows + r]) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            keys[:, b] = key
        mixed = minima * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
        return keys.view(np.int64), mixed.astype(np.uint8)

    def floor(self, similarity: float) -> int:
        """Equal minima below which a pair is not at the threshold: five standard deviations under it."""
        sigma = math.sqrt(similarity * (1 - similarity) / self.total)
        return math.floor(self.total * max(similarity - 5 * sigma, 0))


def _near_pairs(pairs: DataFrame, items: DataFrame, num: int, den: int, floor: int) -> DataFrame:
    """Pairs whose set sizes and signatures allow the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                left = np.frombuffer(b"".join(f["sig_a"]), dtype=np.uint8).reshape(len(f), -1)
                right = np.frombuffer(b"".join(f["sig_b"]), dtype=np.uint8).reshape(len(f), -1)
                yield f.loc[(left == right).sum(axis=1) >= floor, ["a", "b"]]

    a = items.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = items.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(a, "a").join(b, "b").where((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num))
    return sized.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, set()
        for f in frames:
            good = []
            for a, b, x, y in f[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None):
                if (a, x) != last:
                    last, kept = (a, x), shingle_set(words(x), shingle)
                if enough(kept, shingle_set(words(y), shingle), num, den):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # the texts of b come first: a, the leader, is the side that repeats
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long").distinct()


def _block_links(open_members: DataFrame, shape: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int, num: int, den: int, floor: int) -> DataFrame:
    """Confirmed links across components inside each open bucket, in blocks. A pair is looked at in the first bucket that it shares."""
    blocks = shape.select("key", "major", F.ceil(F.col("total") / BLOCK).cast("int").alias("right_blocks"), F.ceil((F.col("total") - F.col("most")) / LEFT_BLOCK).cast("int").alias("left_blocks"))
    rows = open_members.join(blocks, "key").join(signed.join(texts, "id"), "id")
    own = ["key", "id", "c", "n", "keys", "sig", "text"]
    left = rows.where("c <> major").select(
        *own, F.lit(True).alias("minor"), F.pmod(F.xxhash64("id", "key"), "left_blocks").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("rb")
    )
    right = rows.select(
        *own, F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("lb"), F.pmod(F.xxhash64("key", "id"), "right_blocks").alias("rb")
    )

    def compare(group: pd.DataFrame) -> list[tuple[int, int]]:
        minor = group["minor"].to_numpy()
        if minor.all() or not minor.any():
            return []
        sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(len(group), -1)
        keys = np.stack(group["keys"].to_numpy())
        band = int(np.flatnonzero(keys[0] == group["key"].iloc[0])[0])
        ids, comp, n, texts = (group[c].to_numpy() for c in ("id", "c", "n", "text"))
        sets: dict[int, set] = {}

        def set_of(i: int) -> set:
            if ids[i] not in sets:
                sets[ids[i]] = shingle_set(words(texts[i]), shingle)
            return sets[ids[i]]

        others = np.flatnonzero(~minor)
        out = []
        for i in np.flatnonzero(minor):
            at = others[(comp[others] != comp[i]) & (np.minimum(n[others], n[i]) * den >= np.maximum(n[others], n[i]) * num)]
            at = at[(sig[at] == sig[i]).sum(axis=1) >= floor]
            at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in at if enough(set_of(i), set_of(j), num, den)]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            marks = f[["key", "lb", "rb"]].to_numpy()
            cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            edges = [0, *cut, len(f)]
            out = [p for s, e in zip(edges[:-2], edges[1:-1], strict=False) for p in compare(f.iloc[s:e])]
            held = f.iloc[edges[-2] :] if len(f) else None
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"])
        if held is not None and len(held):
            yield pd.DataFrame(sorted(set(compare(held))), columns=["a", "b"])

    placed = [*own, "minor", "lb", "rb"]
    both = left.select(*placed).union(right.select(*placed))
    return both.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb").mapInPandas(run, "a long, b long").distinct()


def _least_and_most(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same keys with their smallest and their largest id: one row for a key with one id, else two."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    edge = keys[1:] != keys[:-1]
    first, last = np.append(True, edge), np.append(edge, True)
    least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    keep = first | (last & (ids != least))
    return keys[keep], ids[keep]


def repeated_keys(items: DataFrame, bands: int) -> DataFrame:
    """``(key)``: the band keys that at least two ids of ``(id, keys)`` have.

    Keys travel packed and by bucket; of each key a task sends and keeps two ids at most, so a key that
    a large share of all items has is as small as any other.
    """
    spark = items.sparkSession
    size = max(1, items.count() * bands / BUCKET_KEYS)
    buckets = 1 << max(math.ceil(math.log2(size)), math.ceil(math.log2(2 * spark.sparkContext.defaultParallelism)) if size > 0.05 else 1)

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            keys = np.concatenate(frame["keys"].to_numpy()).astype(np.int64)
            keys, ids = _least_and_most(keys, np.repeat(frame["id"].to_numpy(dtype=np.int64), frame["keys"].map(len)))
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            bucket, both = bucket[order], np.stack([keys[order], ids[order]], axis=1)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            yield pd.DataFrame({"bucket": bucket[np.append(0, cuts)].astype(np.int32), "packed": [part.tobytes() for part in np.split(both, cuts)]})

    def repeated(both: np.ndarray) -> pd.DataFrame:
        keys, _ = _least_and_most(both[:, 0], both[:, 1])
        return pd.DataFrame({"key": keys[1:][keys[1:] == keys[:-1]]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, rows = None, [], 0
        for frame in frames:
            for name, packed in zip(frame["bucket"], frame["packed"], strict=True):
                if name != bucket and held:
                    yield repeated(np.concatenate(held))
                    held, rows = [], 0
                bucket = name
                held.append(np.frombuffer(packed, dtype=np.int64).reshape(-1, 2))
                rows += len(held[-1])
                if rows > 2 * BUCKET_KEYS:
                    both = np.concatenate(held)
                    held = [np.stack(_least_and_most(both[:, 0], both[:, 1]), axis=1)]
                    rows = min(len(held[0]), BUCKET_KEYS)
        if held:
            yield repeated(np.concatenate(held))

    dealt = items.select("id", "keys").mapInPandas(emit, "bucket int, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(meet, "key long")


def bucket_members(items: DataFrame, bands: int) -> DataFrame:
    """``(key, id)`` of all keys that at least two ids have.

    A bit table of fixed size tells the tasks which keys may repeat, so the others are not shuffled; it
    may be full on a huge table, then they are. The join decides.
    """
    spark = items.sparkSession
    multi = stage(repeated_keys(items, bands), "repeated-keys")
    free_shuffles(spark)
    at = F.shiftright("key", 8).bitwiseAND(F.lit(KEY_BITS - 1))
    words = multi.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(KEY_BITS // 64, dtype=np.uint64)
    table[words["word"]] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            keys = np.concatenate(frame["keys"].to_numpy()).astype(np.int64)
            ids = np.repeat(frame["id"].to_numpy(dtype=np.int64), frame["keys"].map(len))
            at = (keys >> 8) & (KEY_BITS - 1)
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            yield pd.DataFrame({"key": keys[hit], "id": ids[hit]}).drop_duplicates()

    out = stage(items.select("id", "keys").mapInPandas(run, "key long, id long").join(multi, "key").distinct(), "bucket-members")
    release(multi)
    free_shuffles(spark)
    return out


def similar_groups(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], bands: Bands, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Components of the links with similarity at least ``num / den``.

    ``items``: ``(id long, n int, keys array<long>, sig binary)``; repeated rows are harmless.
    ``texts_of`` gets a table of ids and returns their ``(id, text)``. Returns ``(id, component)`` of
    linked items, and the confirmed links ``(a, b)`` that the components rest on.
    """
    members = bucket_members(items, bands.bands)
    ids = stage(members.select("id").distinct(), "bucket-ids")
    signed = stage(items.join(ids, "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "bucket-signatures")
    texts = stage(texts_of(ids), "bucket-texts")
    floor = bands.floor(num / den)
    n_items = signed.count()
    links, labels, shape = None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        if labels is None:
            labelled = members.withColumn("c", F.col("id"))
            buckets = members.groupBy("key").agg(F.min("id").alias("leader")).withColumn("leader_c", F.col("leader"))
            blocks = False
        else:
            if turn > 1:
                release(labelled, shape)
            labelled = stage(members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "labelled-members")
            per = labelled.groupBy("key", "c").agg(F.count("*").alias("n_c"), F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("first"))
            shape = per.groupBy("key").agg(
                F.sum("n_c").alias("total"), F.max("n_c").alias("most"), F.max_by("c", F.struct("n_c", "c")).alias("major"), F.min_by(F.struct("first.id", "c"), "first").alias("leader")
            )
            shape = stage(shape.where("most < total AND total > 2"), "open-buckets")
            work = shape.agg(F.sum((F.col("total") - F.col("most")) * F.col("total"))).first()[0]
            if not work:
                break
            blocks = turn == LEADER_ROUNDS or work <= MOST_COMPARISONS * n_items
            buckets = shape.select("key", F.col("leader.id").alias("leader"), F.col("leader.c").alias("leader_c"))
        if blocks:
            inside = labelled.join(shape.select("key"), "key").select("key", "id", "c")
            found = _block_links(inside, shape, signed, texts, shingle, num, den, floor)
        else:
            pairs = labelled.join(buckets, "key").where("c <> leader_c").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
            found = _confirm(_near_pairs(pairs, signed, num, den, floor), texts, shingle, num, den)
        found = stage(found, "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            edges = found if labels is None else found.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
            labels = stage(connected_components(edges), "components")
        elif labels is None:
            labels = found.select(F.col("a").alias("id"), F.col("b").alias("component"))
        if blocks:
            break
    release(members, ids, signed, texts, *([labelled, shape] if shape is not None else []))
    free_shuffles(items.sparkSession)
    if links is None:
        empty = items.sparkSession.createDataFrame([], "a long, b long")
        return empty.select(F.col("a").alias("id"), F.col("b").alias("component")), empty
    return labels, links

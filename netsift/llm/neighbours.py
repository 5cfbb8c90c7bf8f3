"""Approximate nearest neighbours by cosine, with balanced posting lists.

Vectors are scaled to length one, equal ones are kept once with their smallest
ids. Centroids come from balanced k-means on a bounded sample; their number grows
with the table up to ``max_lists``. A vector near the border of several clusters is
posted to each of them (distance at most ``1 + slack`` times the nearest one's, and
not closer to a list that already has it than to itself). Centroids are held in
memory as a neighbour graph, which posting and searching walk best first.

A query visits every list whose centroid is at most ``ratio`` times as far as the
nearest centroid. The ratio is not guessed: ``calibrate`` finds the exact
neighbours of a bounded sample of vectors in one pass over all rows and takes the
ratio that reaches ``recall`` of them.

Lists are dealt into groups of a bounded number of rows; a query travels once to each
group that holds lists it visits, and only its best rows of the group come back. Long
lists are cut into parts, and many queries of one group into blocks, so a task compares
two bounded blocks; a query sees every part of its lists. Whatever is made for many rows
at once (walks, distances, visits) is made for a bounded number of them.

Edge cases: null or empty vectors, vectors with null or non-finite components, zero
vectors and vectors of another length than the commonest take no part; rows without
an id neither; of rows that share an id the smallest vector counts; with fewer
candidates than ``k`` all are returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import bounded_sample, free_shuffles, release, share_model, stage

#: numbers that a task holds of each side of a comparison, and of one array of distances or scores
SIDE = 1 << 21
CELLS = 1 << 20
#: queries that are compared with all lists of a group before their best rows are taken
TURN = 2048
COPIES = 4


def usable(vector: Column) -> Column:
    """Vectors that have a direction."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part; vectors of floats stay so until they are compared, others are in double precision."""
    kind = rows.schema[vector_col].dataType.simpleString()
    own = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    found = rows.where(F.col(id_col).isNotNull() & F.coalesce(usable(F.col(vector_col)), F.lit(False))).select(F.col(id_col).cast("long").alias("id"), own.alias("v"))
    sizes = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, 1))


def at_once(n: int, cells: int, most: int = CELLS) -> Iterator[slice]:
    """Slices of ``n`` rows, of at most ``most`` numbers where a row needs so many ``cells``."""
    step = max(1, most // max(1, cells))
    return (slice(s, min(s + step, n)) for s in range(0, n, step))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The original vectors scaled by a power of two at most (exact), and their lengths."""
    y = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))
    return y, np.linalg.norm(y, axis=1)


def cosines(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of every pair."""
    (q, q_len), (y, y_len) = scaled(queries), scaled(x)
    return (q @ y.T) / (q_len[:, None] * y_len[None, :])


def balanced_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means; after each round centroids of the smallest clusters move into the largest."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for turn in range(rounds):
        owner = np.concatenate([(x[part] @ centres.T).argmax(axis=1) for part in at_once(len(x), len(centres))])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        sizes = np.bincount(owner, minlength=len(centres))
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 1e-12
        centres[good] = sums[good] / norm[good, None]
        if turn < rounds - 3:
            mean = len(x) / len(centres)
            large = [j for j in np.argsort(-sizes) if sizes[j] > 2 * mean]
            small = [j for j in np.argsort(sizes) if sizes[j] < mean / 4]
            for a, b in zip(small, large, strict=False):
                centres[a] = x[rng.choice(np.flatnonzero(owner == b))]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    graph: np.ndarray  # list x neighbour
    ratio: float = 1.0
    reach: int = 64

    @classmethod
    def build(cls, centres: np.ndarray, degree: int = 24) -> Index:
        near = np.concatenate([np.argsort(-(centres[part] @ centres.T), axis=1, kind="stable")[:, 1 : degree + 1] for part in at_once(len(centres), len(centres))])
        # a few long links keep the graph in one piece
        rng = np.random.default_rng(5)
        far = rng.integers(0, len(centres), (len(centres), 4))
        ring = (np.arange(len(centres))[:, None] + 1) % len(centres)
        return cls(centres, np.concatenate([near, far, ring], axis=1))

    def walk(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``reach`` nearest centroids that a best-first walk finds, and their distances, nearest first."""
        reach = min(reach, len(self.centres))
        # a long walk takes larger steps
        width = max(4, reach // 16)
        # a row needs a mark for each centroid, its nearest ones so far, and the vectors of the next ones
        cells = len(self.centres) // 4 + 4 * reach + 2 * min(width * self.graph.shape[1], len(self.centres)) * x.shape[1]
        found = [self._walk(x[part], reach, width) for part in at_once(len(x), cells, 4 * CELLS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, x: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, c = len(x), len(self.centres)
        x32, centres32 = x.astype(np.float32), self.centres.astype(np.float32)
        seen = np.zeros((n, c), dtype=bool)
        # the nearest ``reach`` centroids so far; what falls out of them is never useful again
        node = np.full((n, reach), -1)
        dist = np.full((n, reach), np.inf, dtype=np.float32)
        open_ = np.zeros((n, reach), dtype=bool)

        def visit(at: np.ndarray, who: np.ndarray) -> None:
            at = np.sort(at, axis=1)
            fresh = ~seen[who[:, None], at]
            fresh[:, 1:] &= at[:, 1:] != at[:, :-1]
            i, j = np.nonzero(fresh)
            seen[who[i], at[i, j]] = True
            dot = np.einsum("ij,ij->i", x32[who[i]], centres32[at[i, j]])
            new = np.full(at.shape, np.inf, dtype=np.float32)
            new[i, j] = np.sqrt(np.maximum(2 - 2 * dot, 0))
            every = np.concatenate([dist[who], new], axis=1)
            kept = np.argpartition(every, reach - 1, axis=1)[:, :reach]
            dist[who] = np.take_along_axis(every, kept, axis=1)
            node[who] = np.take_along_axis(np.concatenate([node[who], at], axis=1), kept, axis=1)
            open_[who] = np.take_along_axis(np.concatenate([open_[who], fresh], axis=1), kept, axis=1)

        active = np.arange(n)
        visit(np.broadcast_to(np.unique(np.linspace(0, c - 1, min(c, 8)).astype(int)), (n, min(c, 8))), active)
        while len(active):
            own = np.where(open_[active], dist[active], np.inf)
            best = np.argpartition(own, min(width, reach - 1), axis=1)[:, :width]
            useful = np.isfinite(np.take_along_axis(own, best, axis=1))
            go = useful.any(axis=1)
            active, best, useful = active[go], best[go], useful[go]
            if not len(active):
                break
            best = np.where(useful, best, best[np.arange(len(best)), useful.argmax(axis=1)][:, None])
            open_[active[:, None], best] = False
            visit(self.graph[node[active[:, None], best]].reshape(len(active), -1), active)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(node, order, axis=1), np.take_along_axis(dist, order, axis=1).astype(np.float64)

    def post(self, x: np.ndarray, slack: float = 0.15) -> list[list[int]]:
        """Lists that get each vector."""
        out = []
        for part in at_once(len(x), 16 * (x.shape[1] + 16)):
            top, dist = self.walk(x[part], 16)
            near = self.centres[top]
            gaps = np.sqrt(np.maximum(2 - 2 * near @ near.transpose(0, 2, 1), 0))
            chosen = np.zeros(top.shape, dtype=bool)
            chosen[:, 0] = True
            for j in range(1, top.shape[1]):
                gap = np.where(chosen, gaps[:, j], np.inf).min(axis=1)
                chosen[:, j] = (chosen.sum(axis=1) < COPIES) & (dist[:, j] <= (1 + slack) * dist[:, 0]) & (gap > dist[:, j] * 0.5)
            out += [t[own].tolist() for t, own in zip(top, chosen, strict=True)]
        return out

    def select(self, x: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """Lists that each query visits: all within the ratio, and further ones until they hold ``least`` rows (``sizes`` of the lists)."""
        top, dist = self.walk(x, self.reach)
        out = [t[d <= self.ratio * d[0] + 1e-6] for t, d in zip(top, dist, strict=True)]
        for i, own in enumerate(out):
            short = sizes is not None and sizes[own].sum() < least
            if len(own) < len(self.centres) and (short or len(own) == top.shape[1]):
                far = np.sqrt(np.maximum(2 - 2 * self.centres @ x[i], 0))
                order = np.argsort(far, kind="stable")
                n = int((far <= self.ratio * far.min() + 1e-6).sum())
                if sizes is not None:
                    n = max(n, int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1)
                out[i] = np.union1d(own, order[:n])
        return out


def exact_neighbours(vectors: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Nearest other vectors of a few queries, from one pass over all vectors; at most ``k`` rows per query and task move."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries["id"].to_numpy(), matrix(queries["v"])))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["query", "score", "id"], ascending=[True, False, True], kind="stable").groupby("query").head(k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        held = None
        for f in frames:
            if not len(f):
                continue
            s = cosines(q, matrix(f["v"]))
            s[ids[:, None] == f["id"].to_numpy()[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(ids)), top.shape[1])
            own = pd.DataFrame({"query": ids[i], "id": f["id"].to_numpy()[top.ravel()], "score": s[i, top.ravel()], "v": f["v"].to_numpy()[top.ravel()]})
            held = best(own if held is None else pd.concat([held, own], ignore_index=True))
        if held is not None:
            yield held[np.isfinite(held["score"])]

    found = vectors.select("id", "v").mapInPandas(run, f"query long, id long, score double, v {vectors.schema['v'].dataType.simpleString()}")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
    return ranked.toPandas()  # k rows for each of a bounded number of queries


def fit(vectors: DataFrame, k: int = 5, sample: int = 20_000, list_size: int = 256, max_lists: int = 4096, probes: int = 256, recall: float = 0.97) -> Index | None:
    """Centroids from at most about ``sample`` vectors, calibrated on at most about ``probes``."""
    n = vectors.count()
    if not n:
        return None
    learnt = bounded_sample(vectors, "id", sample).select("id", "v").toPandas().sort_values("id")
    index = Index.build(balanced_means(unit(matrix(learnt["v"])), int(np.clip(n // list_size, 1, max_lists))))
    calibrate(index, vectors, k, probes, recall)
    return index


def calibrate(index: Index, vectors: DataFrame, k: int, probes: int, recall: float) -> None:
    """Set the distance ratio and the length of the walk."""
    asked = bounded_sample(vectors, "id", probes).select("id", "v").toPandas().sort_values("id").reset_index(drop=True)
    true = exact_neighbours(vectors, asked, k)
    if not len(true):
        return
    q = unit(matrix(asked["v"]))
    lists = index.post(unit(matrix(true["v"])))
    dist = np.sqrt(np.maximum(2 - 2 * q @ index.centres.T, 0))
    row = true["query"].map({i: r for r, i in enumerate(asked["id"])}).to_numpy()
    needed = np.array([dist[r, own].min() / max(dist[r].min(), 1e-9) for r, own in zip(row, lists, strict=True)])
    index.ratio = max(1.0, float(np.quantile(needed, recall))) * 1.005
    within = (dist <= index.ratio * dist.min(axis=1, keepdims=True)).sum(axis=1)
    index.reach = int(min(len(index.centres), np.ceil(within.max() * 1.25) + 16))


def deal_lists(rows: np.ndarray, most: int) -> np.ndarray:
    """A group number for each list: lists in a row share a group until it has ``most`` rows."""
    group = np.zeros(len(rows), dtype=np.int64)
    held = 0
    for j in range(1, len(rows)):
        held += rows[j - 1]
        full = held + rows[j] > most
        group[j] = group[j - 1] + full
        held = 0 if full else held
    return group


def search(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None, **options) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest other rows of every row that ``queries`` selects (a condition on ``id``)."""
    cleaned = stage(clean(rows, id_col, vector_col), "vectors")
    kind = cleaned.schema["v"].dataType.simpleString()
    same = Window.partitionBy("v").orderBy("id")
    distinct = stage(
        cleaned.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors"
    )
    index = index or fit(distinct, k, **options)
    spark = rows.sparkSession
    free_shuffles(spark)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    load = share_model(spark, index)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        for f in frames:
            for part in at_once(len(f), own.centres.shape[1]):
                g = f.iloc[part]
                lists = own.post(unit(matrix(g["v"])))
                yield g.loc[np.repeat(g.index, [len(x) for x in lists])].assign(list=[j for x in lists for j in x])

    posted = stage(distinct.mapInPandas(post, f"v {kind}, id long, ids array<long>, list int"), "postings")
    # ids and rows of each list, two numbers per list; a vector is in COPIES lists at most, so so many ids hold k others
    sizes, lengths = np.zeros(len(index.centres), dtype=np.int64), np.zeros(len(index.centres), dtype=np.int64)
    for r in posted.groupBy("list").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("rows")).collect():
        sizes[r["list"]], lengths[r["list"]] = r["n"], r["rows"]
    # enough groups for the cluster, and never more rows in one than a task holds
    most = max(1, SIDE // index.centres.shape[1])
    most = min(most, max(4096, int(lengths.sum()) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    group = deal_lists(lengths, most)
    parts = np.maximum(1, np.ceil(np.bincount(group, lengths) / most)).astype(np.int64)

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        width = own.centres.shape[1]
        for f in frames:
            for part in at_once(len(f), width + len(own.centres)):
                g = f.iloc[part].reset_index(drop=True)
                lists = [np.sort(x) for x in own.select(unit(matrix(g["v"])), sizes, (k + 1) * COPIES)]
                row = np.repeat(np.arange(len(g)), [len(x) for x in lists])
                visited = np.concatenate(lists).astype(np.int32)
                # lists of a query that lie in one group follow each other
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group[visited], prepend=-1) != 0))
                ends = np.append(first[1:], len(row))
                for some in at_once(len(first), width):
                    at, end = first[some], ends[some]
                    yield g.loc[row[at]].assign(group=group[visited[at]], lists=[visited[a:b] for a, b in zip(at, end, strict=True)])

    asked = stage(cleaned.where(queries).select("id", "v").mapInPandas(select, f"id long, v {kind}, group long, lists array<int>"), "visits")
    release(cleaned, distinct)
    blocks = {r["group"]: -(-r["n"] // most) for r in asked.groupBy("group").agg(F.count("*").alias("n")).collect()}
    # one row per list, at most max_lists, and one per group
    of_list = [(j, int(g), int(parts[g]), int(blocks[g])) for j, g in enumerate(group) if g in blocks]
    shape = F.broadcast(spark.createDataFrame(of_list, "list int, group long, parts long, blocks long"))
    of_group = F.broadcast(spark.createDataFrame([(int(g), int(parts[g]), int(n)) for g, n in blocks.items()], "group long, parts long, blocks long"))
    left = posted.join(shape, "list").select(
        "group", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "list", "id", "ids", "v"
    )
    right = asked.join(of_group, "group").select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.col("id").alias("query"), F.col("v").alias("q"), "lists"
    )

    def first_of(row: np.ndarray, score: np.ndarray, tie: np.ndarray, m: int) -> np.ndarray:
        """Places of the best ``m`` of each row, in order of row, score and tie."""
        order = np.lexsort((tie, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
        return order[place < m]

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame(columns=["query", "ids", "score"])
        x = x.sort_values(["list", "id"]).reset_index(drop=True)
        number, vector_ids, held_ids = x["list"].to_numpy(), x["id"].to_numpy(), x["ids"].to_numpy()
        y, y_len = scaled(matrix(x["v"]))
        out = []
        for part in at_once(len(q), 1, TURN):
            own = q.iloc[part]
            z, z_len = scaled(matrix(own["q"]))
            who = np.repeat(np.arange(len(own)), own["lists"].map(len))
            visited = np.concatenate(own["lists"].to_numpy())
            by_list = np.argsort(visited, kind="stable")
            who, visited = who[by_list], visited[by_list]
            # the last place of the best list of each query so far: nothing below it is among its best
            edge = np.full(len(own), -np.inf)
            found = []
            for j in np.unique(visited):
                a, b = np.searchsorted(number, [j, j + 1])
                callers = who[slice(*np.searchsorted(visited, [j, j + 1]))]
                if a == b:
                    continue
                m = min(k + 1, b - a)
                for some in at_once(len(callers), b - a):
                    c = callers[some]
                    s = (z[c] @ y[a:b].T) / (z_len[c][:, None] * y_len[None, a:b])
                    new = np.isinf(edge[c])
                    low = edge[c]
                    # everything that ties with the last place stays in reach
                    low[new] = np.partition(s[new], s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    r, row = np.nonzero(s >= low[:, None])
                    score = s[r, row]
                    best = first_of(r, score, row, m)
                    r, row, score = r[best], row[best], score[best]
                    if m == k + 1:
                        full = np.flatnonzero(np.bincount(r, minlength=len(c)) == m)
                        edge[c[full]] = np.maximum(edge[c[full]], score[np.searchsorted(r, full, "right") - 1])
                    found.append((c[r], a + row, score))
            if not found:
                continue
            query, row, score = (np.concatenate(f) for f in zip(*found, strict=True))
            # a vector that several lists hold counts once
            once = first_of(query, score, vector_ids[row], len(row))
            query, row, score = query[once], row[once], score[once]
            again = np.lexsort((np.arange(len(row)), vector_ids[row], query))
            fresh = np.ones(len(again), dtype=bool)
            fresh[1:] = (np.diff(query[again]) != 0) | (np.diff(vector_ids[row[again]]) != 0)
            left_over = np.sort(again[fresh])
            query, row, score = query[left_over], row[left_over], score[left_over]
            best = first_of(query, score, vector_ids[row], k + 1)
            out.append(pd.DataFrame({"query": own["query"].to_numpy()[query[best]], "ids": held_ids[row[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["query", "ids", "score"])

    near = left.groupBy("group", "part", "block").cogroup(right.groupBy("group", "part", "block")).applyInPandas(compare, "query long, ids array<long>, score double")
    pairs = near.select("query", F.explode("ids").alias("vec_id"), "score").where("query <> vec_id").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def recall_of(found: DataFrame, rows: DataFrame, queries: pd.DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the exact neighbours of a few queries ``(id, v)`` that a search result holds."""
    true = exact_neighbours(clean(rows, id_col, vector_col), queries, k)
    got = found.where(F.col("query_id").isin([int(i) for i in queries["id"]])).toPandas()
    have = set(zip(got["query_id"], got["vec_id"], strict=True))
    return float(np.mean([x in have for x in zip(true["query"], true["id"], strict=True)])) if len(true) else 1.0

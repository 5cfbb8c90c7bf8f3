"""Exact nearest-neighbour joins by cells around pivots.

Points go to the cell of their nearest pivot. By the triangle inequality a
query needs only the cells that can hold a close enough point, so no cross
join is made. Neighbouring cells are put together into blocks, and the queries of a
block into groups, both of bounded size; each pair of them is one numpy task that
looks only at the cells a query needs and gives only its best rows. A query
travels once to a block, not to each of its cells, and the number of blocks is
fixed until they are full: where nothing can be left out (many dimensions), the
rows sent grow with the input, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.models.base import matrix, squared_distances

MAX_PIVOTS = 8192
CELL_ROWS = 5_000
#: rows of a block of points or of a group of queries, and the most numbers that they hold
BLOCK_ROWS = 100_000
BLOCK_VALUES = 6_400_000
SLACK = 1e-9
#: distances that a task holds at once
DISTANCES = 1_000_000


@dataclass
class Pivots:
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    near: np.ndarray  # the smallest distances from a cell's points to its pivot, inf-padded


def _pieces(rows: np.ndarray, others: int) -> Iterator[np.ndarray]:
    """The rows, as many at a time as make ``DISTANCES`` with so many others; so memory does not grow with them."""
    step = max(1, DISTANCES // max(others, 1))
    for start in range(0, len(rows), step):
        yield rows[start : start + step]


def choose_pivots(points: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Distinct points spread like the data, chosen by hash; at most ``MAX_PIVOTS``."""
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / cell_rows)))
    rows = points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(wanted).collect()
    return np.array([r["x"] for r in rows], dtype=float)


def home_cell(centres: np.ndarray) -> Column:
    """Struct(cell, d): nearest pivot of the column ``x`` and the distance to it."""

    @F.pandas_udf("cell int, d double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({"cell": pd.Series(dtype="int32"), "d": pd.Series(dtype="float64")})
                continue
            cells, least = [], []
            for x in _pieces(matrix(vectors), len(centres)):
                d = np.sqrt(squared_distances(x, centres))
                cells.append(d.argmin(axis=1))
                least.append(d[np.arange(len(d)), cells[-1]])
            yield pd.DataFrame({"cell": np.concatenate(cells).astype("int32"), "d": np.concatenate(least)})

    return nearest("x")


def build_pivots(placed: DataFrame, centres: np.ndarray, k: int = 1) -> Pivots:
    """Per cell: points, radius and the ``k`` smallest distances (``placed`` has cell and d)."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    near = placed.select("cell", "d").withColumn("r", rank).where(F.col("r") <= k).collect()  # at most k per pivot
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()
    radius, counts = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    closest = np.full((len(centres), k), np.inf)
    for r in stats:
        radius[r["cell"]], counts[r["cell"]] = r["far"], r["n"]
    for r in near:
        closest[r["cell"], r["r"] - 1] = r["d"]
    return Pivots(centres, radius, counts, closest)


def _bound(d: np.ndarray, pivots: Pivots, k: int) -> np.ndarray:
    """An upper bound of each query's k-th distance, from the nearest pivots."""
    take = min(len(pivots.centres), 16)
    nearest = np.argpartition(d, take - 1, axis=1)[:, :take]
    while True:
        ends = (np.take_along_axis(d, nearest, axis=1)[:, :, None] + pivots.near[nearest]).reshape(len(d), -1)
        bound = np.full(len(d), np.inf) if ends.shape[1] < k else np.partition(ends, k - 1, axis=1)[:, k - 1]
        if np.isfinite(bound).all() or nearest.shape[1] == d.shape[1]:
            return bound
        nearest = np.broadcast_to(np.arange(d.shape[1]), d.shape)


def _chunks(cells: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """(start, end) of at most so many neighbouring points of one cell; ``cells`` is in order."""
    edges = np.flatnonzero(np.diff(cells)) + 1
    ends = [*edges.tolist(), len(cells)] if len(cells) else []
    return [(at, min(at + rows, end)) for start, end in zip([0, *ends], ends, strict=False) for at in range(start, end, rows)]


def _top_k(queries: pd.DataFrame, points: pd.DataFrame, k: int, skip_self: bool, pivots: Pivots | None = None) -> pd.DataFrame:
    """The best ``k`` of these points for each query, ties by id.

    With ``pivots`` the points have a ``cell`` and the queries a ``bound``, within which their nearest lie.
    A few queries at a time meet the points chunk by chunk, the nearest cells first; the best so far
    shorten the bound for the following ones.
    """
    cells = points["cell"].to_numpy() if pivots else np.zeros(len(points), dtype=np.int64)
    order = np.argsort(cells, kind="stable")
    cells, px, pid = cells[order], matrix(points["x"])[order], points["id"].to_numpy()[order]
    rows = max(1, min(CELL_ROWS, DISTANCES))
    chunks = _chunks(cells, rows)
    known, at_cell = np.unique(cells[[start for start, _ in chunks]], return_inverse=True)
    # queries of one place go together
    queries = queries.sort_values("home") if pivots else queries
    qx, qid = matrix(queries["x"]), queries["id"].to_numpy()
    bounds = queries["bound"].to_numpy() if pivots else np.full(len(queries), np.inf)
    longest = max((x**2).sum(axis=1).max() if len(x) else 0.0 for x in (qx, px))
    # rounding of expanded squares, and of their roots
    noise, margin = SLACK + 1e-12 * longest, SLACK + 1e-6 * np.sqrt(longest)
    out = []
    step = max(1, DISTANCES // max(min(rows, len(px)), 1))
    for start in range(0, len(queries), step):
        x, ids, reach = qx[start : start + step], qid[start : start + step], bounds[start : start + step]
        if pivots:
            gap = np.concatenate([np.sqrt(squared_distances(part, pivots.centres[known])) for part in _pieces(x, len(known))])
            gap = np.maximum(gap - pivots.radius[known][None, :], 0.0)
        else:
            gap = np.zeros((len(x), len(known)))
        best = np.full(len(x), np.inf)
        q, p, distance = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for c in np.argsort(gap.min(axis=0)[at_cell], kind="stable"):
            can = np.flatnonzero(gap[:, at_cell[c]] <= np.minimum(reach, best) + margin)
            if not len(can):
                continue
            low, high = chunks[c]
            d = squared_distances(x[can], px[low:high])
            limit = best[can] ** 2
            if high - low > k and np.isinf(limit).any():
                if skip_self:
                    d[ids[can][:, None] == pid[None, low:high]] = np.inf
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            # distances that tie with the k-th are decided by id, so all of them are kept
            nq, np_ = np.nonzero(d <= (limit * (1 + SLACK) + noise)[:, None])
            usable = np.isfinite(d[nq, np_])
            nq, np_ = can[nq[usable]], np_[usable] + low
            if skip_self:
                other = ids[nq] != pid[np_]
                nq, np_ = nq[other], np_[other]
            if not len(nq):
                continue
            exact = np.sqrt(((x[nq] - px[np_]) ** 2).sum(axis=1))
            q, p, distance = np.concatenate([q, nq]), np.concatenate([p, np_]), np.concatenate([distance, exact])
            rank = np.lexsort((pid[p], distance, q))
            q, p, distance = q[rank], p[rank], distance[rank]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            q, p, distance, place = q[keep], p[keep], distance[keep], place[keep]
            full = place == k - 1
            best[q[full]] = distance[full]
        out.append(pd.DataFrame({"qid": ids[q], "pid": pid[p], "distance": distance}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "pid": [], "distance": []})


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    skip_self: bool = False,
    cell_rows: int = CELL_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest points of each query: (qid, pid, distance), ties by id.

    Both inputs have ``id`` and a vector ``x`` without gaps. ``skip_self``
    leaves out the point with the query's id.
    """
    need = k + 1 if skip_self else k
    n = points.count()
    centres = choose_pivots(points, n, cell_rows)
    placed = points.withColumn("_c", home_cell(centres)).select("id", "x", "_c.cell", "_c.d")
    pivots = build_pivots(placed, centres, need)

    if block_rows is None:
        block_rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(centres.shape[-1], 1)))
    # enough tasks for all cores, as many blocks as groups, so that either side is sent equally often
    side = math.ceil(math.sqrt(3 * points.sparkSession.sparkContext.defaultParallelism))
    first, split, block = _blocks(pivots, block_rows, side)

    @F.pandas_udf("int")
    def block_of(cells: pd.Series, hashes: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series(block[first[at] + hashes.to_numpy() % split[at]].astype("int32"))

    member = np.zeros((len(centres), int(block.max(initial=0)) + 1), dtype=bool)
    member[np.repeat(np.arange(len(centres)), split), block] = True

    @F.pandas_udf("blocks array<int>, bound double, home int")
    def blocks_for(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({"blocks": pd.Series([], dtype=object), "bound": pd.Series(dtype="float64"), "home": pd.Series(dtype="int32")})
                continue
            found, bounds, homes = [], [], []
            for x in _pieces(matrix(vectors), len(centres) * need):
                d = np.sqrt(squared_distances(x, centres))
                bound = _bound(d, pivots, need) + SLACK
                can = (d - pivots.radius[None, :] <= bound[:, None]) & (pivots.counts > 0)[None, :]
                found += [np.flatnonzero(row).astype("int32") for row in can.astype("float32") @ member.astype("float32") > 0]
                bounds.append(bound)
                homes.append(d.argmin(axis=1))
            yield pd.DataFrame({"blocks": found, "bound": np.concatenate(bounds), "home": np.concatenate(homes).astype("int32")})

    sent = queries.select("id", "x", blocks_for("x").alias("_b")).select("id", "x", "_b.bound", "_b.home", F.explode("_b.blocks").alias("blk"))
    loads = {r["blk"]: r["count"] for r in sent.groupBy("blk").count().collect()}
    # a task more for every full group; otherwise only as many as the cores need
    spare = math.ceil(side * side / max(len(loads), 1))
    groups = F.lit(1)
    for b, load in loads.items():
        g = max(math.ceil(load / block_rows), min(spare, math.ceil(load / cell_rows)))
        if g > 1:
            groups = F.when(F.col("blk") == b, g).otherwise(groups)
    left = sent.withColumn("grp", F.pmod(F.xxhash64("id"), groups).cast("int"))
    right = placed.select("id", "x", "cell", block_of("cell", F.xxhash64("id")).alias("blk"))
    right = right.withColumn("grp", F.explode(F.sequence(F.lit(0), groups - 1)))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"qid": [], "pid": [], "distance": []})
        return _top_k(q, p, k, skip_self, pivots)

    keys = ["blk", "grp"]
    id_type = points.schema["id"].dataType.simpleString()
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"qid {id_type}, pid {id_type}, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "pid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _blocks(pivots: Pivots, block_rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell its first unit and number of units, and the block of each unit.

    A cell is one unit, or as many as it fills blocks. Units next to each other along the
    widest dimension share a block of at most about ``block_rows``; there are at least ``least`` blocks if
    there are as many units.
    """
    split = np.maximum(1, -(-pivots.counts // block_rows))
    first = np.cumsum(split) - split
    along = pivots.centres[:, pivots.centres.var(axis=0).argmax()] if len(pivots.centres) else np.zeros(0)
    rows = np.repeat(pivots.counts / split, split)
    order = np.argsort(np.repeat(along, split), kind="stable")
    wanted = max(math.ceil(pivots.counts.sum() / block_rows), min(least, len(rows)))
    before = np.cumsum(rows[order]) - rows[order]
    block = np.zeros(len(rows), dtype=np.int64)
    block[order] = np.floor(before * wanted / max(rows.sum(), 1)).astype(np.int64)
    return first, split, block


def halo_cells(centres: np.ndarray, radius: np.ndarray, reach: float) -> Column:
    """Cells that may hold a point within ``reach`` of the column ``x``."""

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            found = []
            for x in _pieces(matrix(vectors), len(centres)):
                d = np.sqrt(squared_distances(x, centres))
                home = d.min(axis=1)[:, None]
                can = (d <= radius[None, :] + reach + SLACK) & (d - home <= 2 * reach + SLACK) & (radius >= 0)[None, :]
                found += [np.flatnonzero(row).astype("int32") for row in can]
            yield pd.Series(found)

    return near("x")

"""Nearest vectors by largest inner product with collision counting (operator 9).

Vectors get one more component that makes all norms equal, which turns the
largest inner product into the least distance. Each vector is projected on
``PROJECTIONS`` orthogonal random lines. The index is cut into shards by a tree
that halves the vectors by their values on one line after the other, so that a
shard holds vectors that lie close on the lines; it has its vectors' values on
every line in sorted arrays, and the least and largest of them.

A query opens a window around its own value on every line and counts, for each
vector, the windows that hold it; a vector with enough of them is verified by
its inner product. In its own shard the windows start narrow and widen as if
the lines were hashed anew for a larger radius, until the k-th best verified
vector lies within the radius. That radius then holds for all other shards. A
shard whose own values meet too few of the windows has no vector that could
collide often enough, so it isn't opened. A true neighbour is missed only if
its count falls short by more than ``SLACK`` allows.

Shards and blocks of queries are files of bounded size in the shared folder. A
block of queries, which come from one shard, goes to the shards that it needs;
only the best k of each go on.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import new_file, read_range, shared_dir, stored, table

PROJECTIONS = 32
WIDTH = 1.35  #: half a window, in standard deviations of a projected distance at the radius
SLACK = 1.0  #: standard deviations by which a count at the radius may fall short of its mean
GROWTH = 1.12
SHARD_ROWS, BLOCK_QUERIES = 16384, 128
SAMPLE_ROWS = 65_536  #: vectors, chosen by hash, that the tree of shards is fitted to; all are indexed
LEAST_LEAF = 16  #: sampled vectors of a leaf, which bounds the tree; larger leaves are cut by hash
PAIRS, BLOCKS = 16, 2  #: pairs of shard and block, and blocks in their own shard, that are a task's work
K, EVERY, SEED = 20, 20, 11


def lines(dimension: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """``count`` random unit vectors as columns, orthogonal in runs of ``dimension``."""
    rng, parts = np.random.default_rng(seed), []
    while sum(x.shape[1] for x in parts) < count:
        parts.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0])
    return np.concatenate(parts, axis=1)[:, :count]


def threshold(projections: int = PROJECTIONS) -> int:
    p = math.erf(WIDTH / math.sqrt(2))
    return max(1, math.floor(projections * p - SLACK * math.sqrt(projections * p * (1 - p))))


class Tree:
    """Halves a sample by the line on which it spreads most, and each half again, down to leaves."""

    def __init__(self, values: np.ndarray, leaf: int):
        self.axis, self.cut, self.next = [], [], []
        self._grow(values, np.arange(len(values)), leaf)

    def _grow(self, values: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own, node = values[rows], len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.next.append((-1, -1))
        if len(rows) > leaf:
            axis = int(own.var(axis=0).argmax())
            cut = float(np.median(own[:, axis]))
            low = own[:, axis] < cut
            if low.any():
                self.axis[node], self.cut[node] = axis, cut
                self.next[node] = self._grow(values, rows[low], leaf), self._grow(values, rows[~low], leaf)
        return node

    def leaf_of(self, values: np.ndarray) -> np.ndarray:
        """The leaf of each row of values on the lines."""
        axis, cut, after = np.array(self.axis), np.array(self.cut), np.array(self.next)
        at = np.zeros(len(values), np.int64)
        while (open_ := np.flatnonzero(axis[at] >= 0)).size:
            node = at[open_]
            at[open_] = after[node, (values[open_, axis[node]] >= cut[node]).astype(int)]
        return at


class Shard:
    """Sorted projections of some vectors, and the search in them."""

    ARRAYS = ("ids", "vectors", "order", "sorted")

    def __init__(self, space: Space, **arrays: np.ndarray):
        self.space = space
        self.ids, self.vectors, self.order, self.sorted = (arrays[x] for x in self.ARRAYS)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, space: Space) -> Shard:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id].astype(np.float64)
        values = space.values(vectors).T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        return cls(space, ids=ids, vectors=vectors, order=order, sorted=np.take_along_axis(values, order, axis=1))

    def save(self, path: str) -> None:
        _save(path, **{x: getattr(self, x) for x in self.ARRAYS})

    def first_radius(self, k: int) -> float:
        """Distance within which a vector of the shard has about k others, from a few of its own rows."""
        n = len(self.ids)
        some = self.vectors[:: max(1, n // 32)][:32] / self.space.scale
        ip = np.sort(some @ (self.vectors.T / self.space.scale), axis=1)[:, ::-1][:, min(k, n - 1)]
        return math.sqrt(max(1e-12, 2 * self.space.norm**2 - 2 * float(np.median(ip))))

    def search(self, query_id: int, query: np.ndarray, k: int, radius: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and inner products of the best k of one query, its own id left out, and the distance of the last.

        With a ``radius`` the windows are those of that radius, and there may be
        fewer; without, they widen until k vectors lie within theirs.
        """
        n, m, space = len(self.ids), len(self.order), self.space
        own = space.turned(query)
        centre, need, given = own @ space.axes[:-1], threshold(m), radius is not None
        radius, tested = radius if given else self.first_radius(k), np.zeros(n, bool)
        found, scores, far = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        lo, hi = np.zeros(m, np.int64), np.full(m, n)
        count = None
        while True:
            half = space.half(radius)
            left = np.array([np.searchsorted(row, c - half) for row, c in zip(self.sorted, centre, strict=True)])
            right = np.array([np.searchsorted(row, c + half, "right") for row, c in zip(self.sorted, centre, strict=True)])
            if count is None:  # all but what lies outside the windows
                outside = [x for j in range(m) for x in (self.order[j, : left[j]], self.order[j, right[j] :])]
                count = m - np.bincount(np.concatenate(outside), minlength=n)
            else:  # what the windows have taken in since
                taken = [x for j in range(m) for x in (self.order[j, left[j] : lo[j]], self.order[j, hi[j] : right[j]])]
                count += np.bincount(np.concatenate(taken), minlength=n)
            lo, hi = left, right
            new = np.flatnonzero((count >= need) & ~tested)
            tested[new] = True
            new = new[self.ids[new] != query_id]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.vectors[new] * query).sum(axis=1)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, score])
            far = np.concatenate([far, 2 * space.norm**2 - 2 * (self.vectors[new] / space.scale) @ own])
            if given or tested.all() or len(far) >= k and np.partition(far, k - 1)[k - 1] <= radius**2:
                break
            radius *= GROWTH
            if (lo == 0).all() and (hi == n).all():
                need = 0
        best = np.lexsort((self.ids[found], -scores))[:k]
        last = float(np.sqrt(max(np.partition(far, k - 1)[k - 1], 0))) if len(far) >= k else math.inf
        return self.ids[found[best]], scores[best], last


@dataclass
class Space:
    """The lines, and the norm that all vectors get; vectors are divided by ``scale`` against overflow."""

    axes: np.ndarray
    norm: float
    scale: float

    def values(self, vectors: np.ndarray) -> np.ndarray:
        """Values of vectors, their own component for the norm included, on every line."""
        v = vectors / self.scale
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", v, v), 0))
        return v @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def turned(self, query: np.ndarray) -> np.ndarray:
        q = query / np.abs(query).max()
        return q * (self.norm / np.linalg.norm(q))

    def half(self, radius: float) -> float:
        return WIDTH * radius / math.sqrt(len(self.axes))

    def reaches(self, query: np.ndarray, radius: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which shards, given by the ends of their values on the lines, can hold a vector with enough collisions."""
        if not math.isfinite(radius):
            return np.ones(len(low), bool)
        at, half = self.turned(query) @ self.axes[:-1], self.half(radius)
        return ((low <= at + half) & (high >= at - half)).sum(axis=1) >= threshold(low.shape[1])


def usable(vector: str = "embedding") -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _save(path: str, **arrays) -> None:
    data = io.BytesIO()
    np.savez(data, **arrays)
    with new_file(path) as out:
        out.write(data.getvalue())


_OPEN: dict[str, Shard] = {}


def _open(path: str, space: Space) -> Shard:
    """The shard of a file; a worker keeps the last one it used."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Shard(space, **np.load(io.BytesIO(read_range(path))))
    return _OPEN[path]


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query: query_id, rank from 1, vec_id, score.

    Queries are the ids divisible by ``every``; candidates are all rows with
    another id. Vectors that are null, zero or hold a null or non-finite
    component take no part, nor do rows with a null id. All others have to be
    of one length, else there is an error. Of rows that repeat a query's id the
    vector that comes first, component by component, is the query; as
    candidates repeated ids count row by row. Ties go to the smaller id. An
    empty table gives no rows, other columns are left out.
    """
    spark = vectors.sparkSession
    components = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), components.alias("v")).filter(F.col("id").isNotNull() & usable("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    n, least, most, scale = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    own = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    space, path = Space(lines(most + 1), rows.agg(F.sqrt(F.max(own))).first()[0], scale), shared_dir(spark, "vectors")
    draw = F.pmod(F.xxhash64(F.lit("tree"), "id", "v"), F.lit(n)) < SAMPLE_ROWS
    sample = np.array([r["v"] for r in rows.filter(draw).distinct().select("v").collect()], float).reshape(-1, most)
    sample = sample[np.lexsort(sample.T)]
    tree = Tree(space.values(sample), max(LEAST_LEAF, SHARD_ROWS * len(sample) // n))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.leaf_of(space.values(np.stack(batch["v"].to_numpy()))) if len(batch) else np.zeros(0, np.int64))

    placed = stored(rows.mapInPandas(place, "id long, v array<double>, leaf long"), "placed-vectors")
    asked = placed.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "leaf")).alias("q")).select("id", "q.v", "q.leaf")

    def write(kind: str, size: int, chosen: DataFrame) -> DataFrame:
        # a leaf's rows are cut by a hash, as many of them may be at one place
        parts = F.broadcast(chosen.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts")))  # a row for each leaf of the tree
        cut = chosen.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))

        def save(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            at = f"{path}/{kind}-{key[0]:06d}-{key[1]:06d}.npz"
            ids, v = group["id"].to_numpy(np.int64), np.stack(group["v"].to_numpy())
            low = high = []
            if kind == "shard":
                shard = Shard.build(ids, v, space)
                shard.save(at)
                low, high = shard.sorted[:, 0], shard.sorted[:, -1]
            else:
                _save(at, ids=ids, vectors=v)
            return pd.DataFrame({"leaf": [key[0]], "path": [at], "low": [low], "high": [high]})

        return stored(cut.groupBy("leaf", "part").applyInPandas(save, "leaf long, path string, low array<double>, high array<double>"), kind)

    shards, blocks = write("shard", SHARD_ROWS, placed), write("queries", BLOCK_QUERIES, asked)
    summary = f"{path}/shards.npz"

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("path")
        _save(summary, shard=rows["path"].to_numpy().astype(str), leaf=rows["leaf"].to_numpy(), low=np.stack(rows["low"].to_numpy()), high=np.stack(rows["high"].to_numpy()))
        yield pd.DataFrame({"n": [len(rows)]})

    stored(shards.coalesce(1).mapInPandas(summed, "n long"), "shard-ends")  # one row for each shard

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The radius of each query by a search of its own shard, and the shards that lie within it."""
        ends = np.load(io.BytesIO(read_range(summary)))
        for batch in batches:
            for r in batch.sort_values("leaf").itertuples(index=False):
                q, home = np.load(io.BytesIO(read_range(r.path))), np.flatnonzero(ends["leaf"] == r.leaf)
                shard = _open(str(ends["shard"][home[0]]), space)
                own = [shard.search(i, v, k) for i, v in zip(q["ids"], q["vectors"], strict=True)]
                radius = np.array([x[2] for x in own])
                needed = np.zeros(len(ends["shard"]), bool)
                for v, x in zip(q["vectors"], radius, strict=True):
                    needed |= space.reaches(v, x, ends["low"], ends["high"])
                at = r.path.replace("queries-", "asked-")
                needed[home[0]] = True
                _save(at, ids=q["ids"], vectors=q["vectors"], radius=radius, home=str(ends["shard"][home[0]]), n=[len(x[0]) for x in own], found=np.concatenate([x[0] for x in own]), scores=np.concatenate([x[1] for x in own]))
                yield pd.DataFrame({"shard": ends["shard"][needed], "block": at})

    n_blocks = blocks.count()
    pairs = stored(blocks.repartitionByRange(max(1, math.ceil(n_blocks / BLOCKS)), "leaf", "path").mapInPandas(route, "shard string, block string"), "routes")
    work = pairs.repartitionByRange(max(1, math.ceil(pairs.count() / PAIRS)), "shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.sort_values(["shard", "block"]).itertuples(index=False):
                q = np.load(io.BytesIO(read_range(r.block)))
                if r.shard == str(q["home"]):  # searched already
                    yield pd.DataFrame({"query_id": np.repeat(q["ids"], q["n"]), "vec_id": q["found"], "score": q["scores"]})
                    continue
                shard = _open(r.shard, space)
                low, high = shard.sorted[None, :, 0], shard.sorted[None, :, -1]
                found = [(int(i), *shard.search(i, v, k, x if math.isfinite(x) else None)[:2]) for i, v, x in zip(q["ids"], q["vectors"], q["radius"], strict=True) if space.reaches(v, x, low, high)[0]]
                if found:
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    found = work.mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

"""Clustering of bead attributes: standardised, projected and fitted with mixtures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.operators.windows import numbered
from tracelab.session import kept, shared_dir, with_scheme

BLOCK, TILE = 4096, 512  #: rows that a task compares with all rows, and of them at once
TASKS = 64  #: blocks of rows of two attributes, if that makes them large enough
NODES, APART = 18, 2.0  #: places along an axis for sums over rows that are so many half widths of a block away
SHARE, EPS = 32768, 2.0**-52  #: rows of a task in a round of EM; the least density of GaussianMixture
FEW, NEAR = 4, 1e-6  #: attributes that are compared one by one; squares of distances, as a share of those of the rows, that products give too coarsely


def standardised(df: DataFrame, values: list[str]) -> DataFrame:
    """``features``: scores with the sample deviation, missing ones as 0, as a vector.

    The moments are taken once, here, and not again by each job that reads the
    scores; a row for each attribute reaches the driver.
    """
    each = F.array(*(F.col(v).cast("double") for v in values))
    moments = {r["at"]: r for r in df.select(F.posexplode(each).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    known = F.array(*(F.struct(*(F.lit(moments[i][c] if moments else None).cast("double").alias(c) for c in "ms")) for i in range(len(values))))
    scores = F.zip_with(each, known, lambda x, of: F.coalesce(F.try_divide(x - of["m"], of["s"]), F.lit(0.0)))
    return df.select(*df.columns, array_to_vector(scores).alias("features"))


def covariance(df: DataFrame, features: str = "features") -> tuple[np.ndarray, int]:
    """The covariance of a vector column over all rows and their number: sums of products by task, added up by Spark.

    A row for each pair of attributes reaches the driver, whatever the number of rows.
    """
    each = df.select(vector_to_array(features).alias("v"))
    found = each.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.count("*").alias("n")).orderBy("at").collect()
    size, n = len(found), found[0]["n"] if found else df.count()
    if not size or n < 2:
        return np.zeros((size, size)), n
    middle = np.array([r["m"] for r in found])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((size, size))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, size) - middle
            held += x.T @ x
        i, j = np.indices(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(held.ravel())], names=["i", "j", "s"])

    sums = each.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((size, size))
    for r in sums:
        out[r["i"], r["j"]] = r["s"] / (n - 1)
    return out, n


def symmetric_axes(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Values and axes (in columns) of a symmetric matrix by turns of two axes at a time, largest value first.

    An axis has its largest weight positive.
    """
    a, axes = np.array(matrix, float), np.eye(len(matrix))
    for _ in range(sweeps):
        if np.abs(a - np.diag(np.diag(a))).max(initial=0.0) <= 1e-15 * max(np.abs(a).max(initial=0.0), 1e-300):
            break
        for p in range(len(a)):
            for q in range(p + 1, len(a)):
                if a[p, q]:
                    angle = 0.5 * np.arctan2(2 * a[p, q], a[q, q] - a[p, p])
                    c, s = np.cos(angle), np.sin(angle)
                    turn = np.array([[c, s], [-s, c]])
                    a[:, [p, q]] = a[:, [p, q]] @ turn
                    a[[p, q]] = turn.T @ a[[p, q]]
                    axes[:, [p, q]] = axes[:, [p, q]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    axes = axes[:, order]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(axes))]) if len(axes) else np.ones(0)
    return np.diag(a)[order], axes * np.where(signs == 0, 1.0, signs)


def principal_axes(df: DataFrame, dimensions: int | None = None, features: str = "features") -> DataFrame:
    """The axes of most variance: component, variance, share (of all variance), residual, weights.

    ``residual`` is the length of A v - l v for the covariance A, the proof that
    weights v and variance l belong together.
    """
    a, _ = covariance(df, features)
    values, axes = symmetric_axes(a)
    total = float(values.sum())
    rows = [(j, float(values[j]), float(values[j]) / total if total else 0.0, float(np.linalg.norm(a @ axes[:, j] - values[j] * axes[:, j])), axes[:, j].tolist()) for j in range(len(values))]
    return df.sparkSession.createDataFrame(rows[:dimensions], "component int, variance double, share double, residual double, weights array<double>")


def projected(df: DataFrame, dimensions: int = 2) -> DataFrame:
    """Principal components of ``features``, each with its largest weight positive."""
    axes = symmetric_axes(covariance(df)[0])[1].T[:dimensions].tolist()
    along = [F.aggregate(F.zip_with("__v", F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for axis in axes]
    return df.withColumn("__v", vector_to_array("features")).withColumn("projection", array_to_vector(F.array(*along))).drop("__v")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to those of ``y``: by products of matrices, near ones by differences."""
    if x.shape[1] <= FEW:
        squares = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            squares += np.square(np.subtract.outer(x[:, j], y[:, j]))
        return np.sqrt(squares, out=squares)
    size = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    squares = size - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= NEAR * size)
    squares[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(squares)


def _between(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev places of the box around the rows of ``x``, which have two attributes, and what each weighs at each row."""
    low, high, k = x.min(axis=0), x.max(axis=0), np.arange(NODES)
    middle, half, t = (low + high) / 2, (high - low) / 2, np.cos((2 * k + 1) * np.pi / (2 * NODES))
    known = np.cos(np.outer(k, np.arccos(t))) * np.where(k, 2.0, 1.0)[:, None] / NODES
    first, second = (np.cos(np.outer(np.arccos(np.clip((x[:, j] - middle[j]) / (half[j] or 1.0), -1, 1)), k)) @ known for j in range(2))
    places = middle + half * np.stack(np.meshgrid(t, t, indexing="ij"), axis=-1).reshape(-1, 2)
    return places, (first[:, :, None] * second[:, None, :]).reshape(len(x), -1)


def _away(x: np.ndarray, tiles: Iterable[tuple[np.ndarray, np.ndarray]], clusters: int) -> np.ndarray:
    """Sums of the distances of each row of ``x`` to the rows of each cluster, over tiles of rows and the clusters that each is in.

    Rows of two attributes lie close together in a block, and the sum of the
    distances to rows far from all of them is a smooth function there: it is
    taken at the places of ``_between`` and interpolated, which is exact up to
    rounding (tested to 1e-12 of the sum). Where a tile isn't far from a block
    the same goes for its quarters, and so on. No row of a tile is left out.
    """
    sums, step = np.zeros((len(x), clusters)), TILE // 8 if x.shape[1] <= FEW else TILE

    def group(a: int, b: int) -> tuple:
        """Rows from a to b with their box, the places in it with the sums there, and the quarters."""
        few = x.shape[1] != 2 or b - a <= NODES**2
        cuts = np.linspace(a, b, 5).astype(int).tolist() if not few and b - a > 4 * NODES**2 else []
        quarters = [group(*cut) for cut in zip(cuts, cuts[1:], strict=False)]
        return a, b, x[a:b].min(axis=0), x[a:b].max(axis=0), None if few else _between(x[a:b])[0], None if few else np.zeros((NODES**2, clusters)), quarters

    def add(at: np.ndarray, into: np.ndarray, y: np.ndarray, runs: np.ndarray, member: np.ndarray) -> None:
        for a in range(0, len(at), step):
            into[a : a + step] += np.add.reduceat(_distances(at[a : a + step], y), runs, axis=1) @ member

    whole = group(0, len(x))
    for y, of in tiles:
        order = np.lexsort(of.T)
        y, of = y[order], of[order]
        runs = np.r_[0, np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1]
        member = np.zeros((len(runs), clusters))
        member[np.arange(len(runs))[:, None], of[runs]] = 1.0
        first, last, todo = y.min(axis=0), y.max(axis=0), [whole]
        while todo:
            a, b, low, high, places, smooth, quarters = todo.pop()
            if places is not None and np.maximum(first - high, low - last).max() >= APART * (high - low).max() / 2:
                add(places, smooth, y, runs, member)
            elif quarters:
                todo += quarters
            else:
                add(x[a:b], sums[a:b], y, runs, member)
    todo = [whole]
    while todo:
        a, b, _, _, places, smooth, quarters = todo.pop()
        if places is not None:
            sums[a:b] += _between(x[a:b])[1] @ smooth
        todo += quarters
    return sums


def _curve(df: DataFrame) -> Column:
    """The place of ``v``, arrays of two numbers, along a curve that goes through the plane square by square."""
    box = df.agg(*(f(F.get("v", F.lit(j))).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(2))).first()

    @F.pandas_udf("long")
    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for j, v in enumerate((x, y)):
            at = np.nan_to_num((v.to_numpy(float) - box[f"min{j}"]) / ((box[f"max{j}"] - box[f"min{j}"]) or 1.0)).clip(0, 1)
            bits = (at * 65535).astype(np.int64)
            for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
                bits = (bits | bits << shift) & mask
            out |= bits << j
        return pd.Series(out)

    return place(F.get("v", F.lit(0)), F.get("v", F.lit(1)))


def silhouettes(df: DataFrame, labels: list[str], features: str = "features") -> DataFrame:
    """How well each column of labels parts the rows: labelling, silhouette, by Euclidean distances of all pairs.

    The mean over rows of (b - a) / max(a, b), a the mean distance to the others
    of the own cluster and b the least mean distance to another; 0 for a row
    alone in its cluster, null where there is one cluster only. A task holds a
    block of rows and reads the files of all rows past them, so no pair is
    shuffled; the distances serve all labellings. The work goes with the square
    of the rows, as the measure does, memory and disk do not. With two
    attributes blocks are compact, sums over far rows are interpolated
    (``_away``), and the work goes with the rows up to ``TASKS`` blocks of the
    largest size, if they are evenly spread.
    """
    spark, path = df.sparkSession, with_scheme(df.sparkSession, shared_dir(df.sparkSession, "silhouette-rows"))
    rows = kept(df.select(vector_to_array(features).alias("v"), F.array(*(F.col(c).cast("long") for c in labels)).alias("l"), F.monotonically_increasing_id().alias("row")), "silhouette-start")
    sizes: list[dict[int, int]] = [{} for _ in labels]
    for r in rows.select(F.posexplode("l").alias("no", "label")).groupBy("no", "label").count().collect():  # a row for each cluster
        sizes[r["no"]][r["label"]] = r["count"]
    known = [np.array(sorted(s), np.int64) for s in sizes]
    number = [np.array([s[label] for label in sorted(s)], float) for s in sizes]
    ends = np.cumsum([0, *map(len, number)])
    n = sum(sizes[0].values()) if labels else 0
    plane = rows.agg(F.max(F.size("v"))).first()[0] == 2
    block = min(4 * BLOCK, max(2 * TILE, n // TASKS)) if plane else BLOCK
    placed = numbered(rows.withColumn("curve", _curve(rows) if plane else F.lit(0)), ["curve", "row"], "at").withColumn("block", F.floor(F.col("at") / block))
    placed.repartitionByRange(max(1, -(-n // block)), "block").sortWithinPartitions("at").select("block", "v", "l").write.parquet(path)
    dealt = spark.read.parquet(path).repartitionByRange(max(1, -(-n // block)), "block").sortWithinPartitions("block")

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, and for each labelling the place of a row's cluster among all of all labellings."""
        v, own = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("v", "l"))
        return v, np.stack([ends[no] + np.searchsorted(k, own[:, no]) for no, k in enumerate(known)], axis=1)

    def everyone() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows from their files, ``TILE`` at a time."""
        system, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        for info in system.get_file_info(pafs.FileSelector(at)):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(TILE, columns=["v", "l"]):
                        if len(batch):
                            yield unpacked(batch)

    def scores(x: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        sums = _away(x, everyone(), int(ends[-1]))
        total = []
        for no, sized in enumerate(number):
            at = np.arange(len(own)), own[:, no] - ends[no]
            size, away = sized[at[1]], sums[:, ends[no] : ends[no + 1]]
            a = away[at] / np.maximum(size - 1, 1)
            means = away / sized
            means[at] = np.inf
            b = means.min(axis=1)
            with np.errstate(invalid="ignore"):
                s = np.where(size > 1, np.nan_to_num((b - a) / np.maximum(np.maximum(a, b), 1e-300)), 0.0)
            total.append(float(s.sum()) if len(sized) > 1 else None)
        return pa.RecordBatch.from_arrays([pa.array(range(len(number)), pa.int32()), pa.array(total, pa.float64()), pa.array([len(own)] * len(number), pa.int64())], names=["no", "s", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block by block, which may begin and end inside a batch."""
        block, held = None, []
        for batch in batches:
            names = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and names[a] != block:
                    yield scores(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                if b > a:
                    block = names[a]
                    held.append(unpacked(batch.slice(a, b - a)))
        if held:
            yield scores(*map(np.concatenate, zip(*held, strict=True)))

    summed = dealt.mapInArrow(compare, "no int, s double, n long").groupBy("no").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    return summed.select(F.get(F.array(*map(F.lit, labels)), F.col("no")).alias("labelling"), "silhouette")


class Mixture(NamedTuple):
    """Parts of a mixture of Gaussians: shares, means and covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


def _weighed(x: np.ndarray, parts: list[tuple[float, float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted densities of rows in each of ``parts``, with the least one that ``GaussianMixture`` adds."""
    return np.stack([EPS + w * np.exp(scale - 0.5 * (((x - mean) @ root) ** 2).sum(axis=1)) for w, scale, mean, root in parts], axis=1)


def _parts(mixture: Mixture) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Weight, scale of the logarithm, mean and root of the inverse of each part; axes without width are left out of the root."""
    out = []
    for w, mean, covariance in zip(*mixture, strict=True):
        values, axes = np.linalg.eigh(covariance)
        wide = values > EPS * values.max() * len(values)
        if not wide.any():
            raise ValueError("a part of the mixture has no width in any direction")
        out.append((w, -0.5 * (len(values) * math.log(2 * math.pi) + np.log(values[wide]).sum()), mean, axes[:, wide] / np.sqrt(values[wide])))
    return out


def fitted(df: DataFrame, starts: list[Mixture], features: str = "features", tolerance: float = 0.01, rounds: int = 100) -> list[tuple[Mixture, float, int]]:
    """Each mixture after its rounds of EM, with its log-likelihood and the number of rounds.

    The rounds and their end are those of ``GaussianMixture``, but a round is one
    job for all mixtures that go on: each task sums over its rows, the sums are
    added up by Spark, and so many numbers as the mixtures have come to the
    driver. Rows are dealt out ``SHARE`` to a task, however their files are cut.
    """
    points = df.select(vector_to_array(features).alias("v"))
    d = starts[0].means.shape[1]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("v").flatten().to_numpy().tobytes()], pa.binary())], names=["x"])

    dealt = points.repartition(max(1, -(-points.count() // SHARE))).mapInArrow(packed, "x binary")
    blocks = dealt.rdd.map(lambda r: np.frombuffer(r["x"]).reshape(-1, d)).persist(StorageLevel.MEMORY_AND_DISK)

    def add_up(going: list[list[tuple]]) -> list[np.ndarray]:
        def sums(held: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
            total = 0.0
            for x in held:
                each = []
                for parts in going:
                    p = _weighed(x, parts)
                    likely = p.sum(axis=1)
                    p /= likely[:, None]
                    each += [[np.log(likely).sum()], p.sum(axis=0), (p.T @ x).ravel(), *(((p[:, j, None] * x).T @ x).ravel() for j in range(len(parts)))]
                total = total + np.concatenate(each)
            if not np.isscalar(total):
                yield total

        total = blocks.mapPartitions(sums).treeReduce(np.add)
        return np.split(total, np.cumsum([1 + len(parts) * (1 + d + d * d) for parts in going])[:-1])

    out = [(m, -np.inf, 0) for m in starts]
    try:
        going = list(range(len(starts)))
        for done in range(1, rounds + 1):
            found = add_up([_parts(out[i][0]) for i in going])
            still = []
            for i, s in zip(going, found, strict=True):
                k, before = len(out[i][0].weights), out[i][1]
                w, means, squares = s[1 : 1 + k], s[1 + k : 1 + k + k * d].reshape(k, d), s[1 + k + k * d :].reshape(k, d, d)
                means = means / w[:, None]
                out[i] = Mixture(w / w.sum(), means, squares / w[:, None, None] - means[:, :, None] * means[:, None, :]), float(s[0]), done
                if abs(s[0] - before) > tolerance:
                    still.append(i)
            going = still
            if not going:
                break
        return out
    finally:
        blocks.unpersist()


def clustered(df: DataFrame, ks: range = range(2, 10), seed: int = 1, features: str = "projection", shapes: bool = True) -> tuple[DataFrame, list[dict]]:
    """Rows with ``label`` from the mixture of the least BIC, and the scores of all numbers of clusters.

    All numbers start from the draws of ``GaussianMixture`` and are fitted in
    the same rounds; their silhouettes come from one pass over all pairs of
    rows, which a caller that needs no ``shapes`` is spared.
    """
    points = df.select(features).persist()
    try:
        n = points.count()

        def start(k: int) -> Mixture:
            model = GaussianMixture(k=k, seed=seed, maxIter=0, featuresCol=features).fit(points)
            return Mixture(np.array(model.weights), *(np.stack(v) for v in zip(*((g.mean.toArray(), g.cov.toArray()) for g in model.gaussians), strict=True)))

        with ThreadPoolExecutor(len(ks)) as pool:
            starts = list(pool.map(start, ks))
        d = starts[0].means.shape[1]
        fits = fitted(points, starts, features)
        free = [k - 1 + k * d + k * d * (d + 1) // 2 for k in ks]
        scores = [{"k": k, "bic": of * math.log(n) - 2 * likely} for k, of, (_, likely, _) in zip(ks, free, fits, strict=True)]
        if shapes:
            names = [f"label_{k}" for k in ks]
            found = _labels([m for m, _, _ in fits])(vector_to_array(features))
            labelled = points.select(features, found.alias("__l")).select(features, *(F.get("__l", F.lit(i)).alias(c) for i, c in enumerate(names)))
            shape = {r["labelling"]: r["silhouette"] for r in silhouettes(labelled, names, features).collect()}
            scores = [s | {"silhouette": shape[c] if shape[c] is not None else float("nan")} for s, c in zip(scores, names, strict=True)]
        best = min(range(len(scores)), key=lambda i: scores[i]["bic"])
        return kept(df.select(*df.columns, F.get(_labels([fits[best][0]])(vector_to_array(features)), F.lit(0)).alias("label")), "labels"), scores
    finally:
        points.unpersist()


def _labels(mixtures: list[Mixture]) -> Callable[[Column], Column]:
    """The likeliest part of each mixture, for a column of arrays."""
    every = [_parts(m) for m in mixtures]

    @F.pandas_udf("array<int>")
    def labels(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(len(v), -1)
        return pd.Series(np.stack([_weighed(x, parts).argmax(axis=1) for parts in every], axis=1).astype(np.int32).tolist())

    return labels


def label_moments(df: DataFrame, label: str = "label", value: str = "x") -> DataFrame:
    """What labels make of a mixture: label, f (share of the rows), m, s (population deviation), n."""
    each = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return each.crossJoin(F.broadcast(df.agg(F.count("*").alias("__all")))).select(label, (F.col("n") / F.col("__all")).alias("f"), "m", "s", "n")

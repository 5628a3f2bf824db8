"""Transforms, lag variances, searches, selections and starts against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelab.operators import changepoint, clustering, fourier, kmeans, mixture, spectral, stats, windows

XS = "trace_id long, idx long, x double"


def traces(spark, values):
    return spark.createDataFrame([(t, i, None if v is None else float(v)) for t, v_ in values.items() for i, v in enumerate(v_)], XS)


# Transforms

@pytest.mark.parametrize("n, whole", [(1, 4096), (20, 4096), (64, 8), (2048, 16), (60, 8), (97, 8), (1000, 64)])
@pytest.mark.parametrize("inverse", [False, True])
def test_transform_equals_numpy(spark, n, whole, inverse):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n) + 1j * rng.normal(size=n)
    v[rng.random(n) < 0.2] = 0
    df = spark.createDataFrame([(int(i), float(v[i].real), float(v[i].imag)) for i in rng.permutation(n) if v[i] or i == 0], "at long, re double, im double")
    got = fourier.fourier(df, n, inverse, whole).orderBy("at").toPandas()
    want = np.fft.ifft(v) if inverse else np.fft.fft(v)
    assert got["at"].tolist() == list(range(n))
    np.testing.assert_allclose(got["re"] + 1j * got["im"], want, atol=1e-9)


def test_fine_spectrum_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(fourier, "TOGETHER", 1 << 10)
    x = np.random.default_rng(2).gamma(3, 40, 3000)
    got = spectral.position_spectrum(traces(spark, {0: x}), 200.0).orderBy("k").toPandas()
    counts = np.histogram(x, np.floor(x.min()) + np.arange(len(got) + 1) / 200)[0]
    acf = np.rint(np.fft.irfft(np.abs(np.fft.rfft(counts, 2 * len(counts))) ** 2))[: len(counts)]
    assert len(got) > 50_000 and acf[0] == (counts**2).sum()
    np.testing.assert_allclose(got["psd"], np.abs(np.fft.fft(acf)), rtol=1e-9, atol=1e-5)


def test_products_below_limits():
    rng = np.random.default_rng(0)
    for n, begin in ((7, 1), (500, 1), (3000, 700)):
        x, m = rng.normal(size=n), np.arange(begin, n // 2 + 1)
        got = fourier.lagged_products(x, x, 0, 0, begin, n // m * m)
        np.testing.assert_allclose(got, [(x[k : n // k * k] * x[: n // k * k - k]).sum() for k in m], atol=1e-9)


# Variances at all lags

@pytest.mark.parametrize("stretch", [1 << 16, 16, 7])
def test_lag_variance_at_all_lags(spark, stretch):
    rng = np.random.default_rng(stretch)
    values = {7: rng.normal(1e4, 3, 101).cumsum(), 8: [*rng.normal(size=40), None, None, *rng.normal(size=18)], 9: [1.0], 10: [1.0, 4.0], 11: [2.0] * 12}
    got = spectral.lag_variance_full(traces(spark, values), stretch=stretch).orderBy("trace_id", "m").toPandas()
    want = []
    for t, v in values.items():
        v, seen = np.array([np.nan if y is None else y for y in v]), []
        for m in range(1, len(v) // 2 + 1):
            d = np.diff(v[: len(v) // m * m].reshape(-1, m), axis=0).ravel()
            d = d[~np.isnan(d)]
            seen += [d.var(ddof=1)] if len(d) > 1 else []
            want.append((t, m, seen[-1] if len(d) > 1 else np.nan, d.mean(), np.std(seen, ddof=1) if len(seen) > 1 else np.nan))
    want = pd.DataFrame(want, columns=got.columns)
    assert got[["trace_id", "m"]].equals(want[["trace_id", "m"]].astype("int64"))
    for c in ("var_x", "mean_x", "sem_x"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-7, atol=1e-6, err_msg=c)


# The least loss by branch and bound

def level_ramp_level(rng, n, t1, t2, noise):
    i = np.arange(n)
    return np.interp(i, [t1, t2], [20, 70]) + rng.normal(0, noise, n)


def all_pairs(x):
    best = None
    for t1 in range(1, len(x) - 1):
        for t2 in range(t1 + 1, len(x)):
            c1, c2, m = x[:t1].mean(), x[t2:].mean(), t2 - t1
            ramp = c1 + ((c2 - c1) / (m - 1) * np.arange(m) if m > 1 else 0)
            loss = ((x[:t1] - c1) ** 2).sum() + ((x[t2:] - c2) ** 2).sum() + ((x[t1:t2] - ramp) ** 2).sum()
            best = min(best or (np.inf, 0, 0), (loss, t1, t2))
    return best


def test_search_finds_the_least_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = {0: level_ramp_level(rng, 120, 30, 80, 3), 1: rng.normal(0, 1, 61), 2: level_ramp_level(rng, 90, 5, 85, 20), 3: [1.0, 5.0, 9.0], 4: [1.0, 2.0], 5: rng.normal(size=40).cumsum()}
    for width, stretch in ((16, 512), (3, 2)):
        monkeypatch.setattr(changepoint, "LEAST_WIDTH", width)
        monkeypatch.setattr(changepoint, "STRETCH", stretch)
        got = {r["trace_id"]: r for r in changepoint.searched_change_points(traces(spark, values)).collect()}
        assert sorted(got) == [0, 1, 2, 3, 5]
        for t, r in got.items():
            loss, t1, t2 = all_pairs(np.array(values[t]))
            assert (r["t1"], r["t2"]) == (t1, t2) and r["loss"] == pytest.approx(loss, abs=1e-6)


def test_search_opens_few_pairs(spark):
    x = level_ramp_level(np.random.default_rng(6), 3000, 800, 2000, 4)
    r = changepoint.searched_change_points(traces(spark, {0: x})).first()
    assert abs(r["t1"] - 800) < 60 and abs(r["t2"] - 2000) < 60
    assert r["pairs"] > 1400 and r["opened"] < r["pairs"] / 10


def test_bounds_stay_below_their_pairs(spark, monkeypatch):
    """Every pair's loss is at or above the bound of its stretches, as no result changes when all are opened."""
    rng = np.random.default_rng(8)
    values = {t: rng.normal(size=50).cumsum() + 1e3 * t for t in range(4)}
    df = traces(spark, values)
    losses = changepoint.candidate_losses(df).groupBy("trace_id").agg(F.min(F.struct("loss", "t1", "t2")).alias("b")).select("trace_id", "b.t1", "b.t2").collect()
    assert sorted(map(tuple, losses)) == sorted(tuple(r)[:3] for r in changepoint.best_change_points(df).collect())


# Exact quantiles

@pytest.mark.parametrize("held", [10_000, 50, 1])
def test_quantiles_are_exact(spark, held):
    rng = np.random.default_rng(held)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([0.0, 1.0], 500), "c": np.r_[np.zeros(490), rng.random(20), np.ones(490)], "d": [3.5], "e": rng.integers(0, 3, 800).astype(float), None: np.exp(rng.normal(size=700) * 20), "f": np.zeros(900)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = stats.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs, held)
    have = {(r["g"], r["p"]): r["quantile"] for r in got.collect()}
    assert len(have) == len(groups) * len(probs)
    for g, v in groups.items():
        np.testing.assert_allclose([have[g, p] for p in probs], np.quantile(v, probs), rtol=1e-12)


def test_summary_of_large_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v), float(v * k)) for k in (1, 2, 3) for v in rng.normal(size=40 * k)] + [(None, 1.0, None), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    whole, parts = (stats.summary(df, ["k"], ["x", "y"], held).toPandas().sort_values(["k", "attr"]).reset_index(drop=True) for held in (4096, 60))
    pd.testing.assert_frame_equal(whole, parts)
    assert len(whole) == 8


def test_quantiles_of_all_and_of_none(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    assert [tuple(r) for r in stats.quantiles(df, [], "x", [0.25], 7).collect()] == [(0.25, 25.0)]
    assert stats.quantiles(df.limit(0), [], "x", [0.25]).count() == 0


# k-means

def test_kmeans_of_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"a": np.r_[rng.normal(0, 1, 200), rng.normal(50, 2, 100), rng.normal(90, 1, 50)], None: np.r_[rng.normal(-5, 0.1, 30), rng.normal(5, 0.1, 70), rng.normal(20, 0.1, 20)], "few": [1.0, 1.0, 2.0], "one": [4.0] * 9}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)], "g string, x double")
    got = {}
    for r in kmeans.kmeans(df, 3, ["g"]).orderBy("m").collect():
        got.setdefault(r["g"], []).append((r["n"], r["m"], r["s"], r["f"]))
    assert [n for n, *_ in got["a"]] == [200, 100, 50] and [n for n, *_ in got[None]] == [30, 70, 20]
    assert [x[:2] for x in got["few"]] == [(2, 1.0), (1, 2.0)] and got["one"] == [(9, 4.0, 0.0, 1.0)]
    a = groups["a"][:200]
    assert got["a"][0][1:3] == pytest.approx((a.mean(), a.std())) and sum(x[3] for x in got["a"]) == pytest.approx(1)


def test_means_are_settled(spark):
    x = np.random.default_rng(9).gamma(2, 30, 2000)
    m = [r["m"] for r in kmeans.kmeans(spark.createDataFrame([(float(v),) for v in x], "x double"), 5).orderBy("m").collect()]
    near = np.abs(x[:, None] - np.array(m)).argmin(axis=1)
    np.testing.assert_allclose(m, [x[near == j].mean() for j in range(5)], rtol=1e-6)


def test_mixture_from_kmeans(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in np.r_[rng.normal(10, 2, 600), rng.normal(30, 3, 400)]], "x double")
    fit = mixture.fit_mixture(df, "gauss", 2, first=mixture.kmeans_starts(df, 2))[0]
    assert fit.ordered()["m"] == pytest.approx([10, 30], abs=0.5) and fit.n == 1000


# Sums and numbers over ranges

def test_sums_of_earlier_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 9, 300)
    df = spark.createDataFrame([(int(i), int(x), i % 7) for i, x in enumerate(v)], "id long, v long, tie int").repartition(9)
    got = windows.earlier_sum(df, ["tie", "id"], F.col("v"), "before").toPandas().sort_values(["tie", "id"])
    assert got["before"].tolist() == [0, *got["v"].cumsum().tolist()[:-1]]
    assert windows.numbered(df, ["id"], "n").filter("n <> id").count() == 0
    assert windows.numbered(df.limit(0), ["id"], "n").count() == 0
    some = windows.earlier_sum(df.limit(1).select("id", F.lit(None).cast("double").alias("x")), ["id"], F.col("x"), "before").first()
    assert some["before"] == 0


# Principal axes

@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_axes_of_symmetric_matrices(n):
    m = np.random.default_rng(n).normal(size=(n, n))
    for a in (m @ m.T, m + m.T, np.eye(n), np.zeros((n, n)), np.ones((n, n))):
        values, axes = clustering.symmetric_axes(a)
        np.testing.assert_allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-9)
        np.testing.assert_allclose(axes.T @ axes, np.eye(n), atol=1e-9)
        np.testing.assert_allclose(a @ axes, axes * values, atol=1e-8)


def test_principal_axes_of_rows(spark):
    x = np.random.default_rng(7).normal(size=(400, 3)) @ np.array([[3.0, 1, 0], [0, 1, 0], [0, 0, 0.2]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = clustering.principal_axes(clustering.standardised(df, list("abc"))).orderBy("component").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    np.testing.assert_allclose(got["variance"], np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1], atol=1e-9)
    assert got["share"].sum() == pytest.approx(1) and got["residual"].max() < 1e-9
    p = np.array([r["projection"].toArray() for r in clustering.projected(clustering.standardised(df, list("abc"))).collect()])
    np.testing.assert_allclose(np.cov(p.T), np.diag(got["variance"][:2]), atol=1e-9)


def test_minibatch_nears_the_exact_fit(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-3, 3, 600)
    df = spark.createDataFrame([(float(a), float(10 * a + 3 * a**2 + a**3 + e)) for a, e in zip(x, rng.normal(0, 1, 600), strict=True)], "x double, y double")
    np.testing.assert_allclose(changepoint.cubic_minibatch(df), changepoint.cubic_exact(df), atol=0.4)


# Leaps of mixtures

def test_leaps_save_rounds(spark):
    rng = np.random.default_rng(21)
    df = spark.createDataFrame([(float(v),) for v in np.r_[rng.normal(0, 2, 500), rng.normal(5, 2, 500)]], "x double").coalesce(1)
    plain, fast = (mixture.fit_mixture(df, "gauss", 2, tolerance=1e-5, most=400, least_sigma=0.1, leaps=leaps)[0] for leaps in (False, True))
    assert plain.converged and fast.converged and fast.rounds * 3 <= plain.rounds
    for n in ("f", "m", "s"):
        assert fast.ordered()[n] == pytest.approx(plain.ordered()[n], abs=1e-3)
    assert fast.ln_likelihood >= plain.ln_likelihood - 1e-6


def test_random_starts_repeat(spark):
    from tracelab.operators.generate import uniform

    df = spark.createDataFrame([(1.0,), (9.0,)], "x double")
    a, b = (mixture.random_starts(df, "gauss", [2, 3], 2, 5) for _ in range(2))
    assert [f.params for f in a] == [f.params for f in b] and len({f.params["m"][0] for f in a}) == 4
    drawn = [spark.range(1).select(uniform(5, "m", F.lit(3), F.lit(1), F.lit(j))).first()[0] * 9.0 for j in range(3)]
    assert a[3].params["m"] == pytest.approx(sorted(drawn))


def test_rounds_go_over_distinct_rows(spark, monkeypatch):
    from tracelab.operators import mixture

    seen, plain = [], mixture._sums
    monkeypatch.setattr(mixture, "_sums", lambda df, *rest: seen.append(df.count()) or plain(df, *rest))
    df = spark.range(400).select((F.col("id") % 8 + F.when(F.col("id") % 2 == 0, 20).otherwise(0)).cast("double").alias("x"))
    fit = mixture.fit_mixture(df, "gauss", 2)[0].ordered()
    assert set(seen) == {8} and fit["f"] == pytest.approx([0.5, 0.5]) and fit["m"] == pytest.approx([4, 23])


# Ranges from sketches

def test_ranges_of_a_sketch_are_taken_once(spark):
    from tracelab.operators import stats

    rows = spark.range(3000).select((F.col("id") % 997).cast("double").alias("x"))
    found = stats.survival(rows)
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = {float(v): 1 - sum(1 for i in range(3000) if i % 997 <= v) / 3000 for v in (0, 500, 996)}
    assert {r["value"]: r["survival"] for r in found.filter(F.col("value").isin(*whole)).collect()} == pytest.approx(whole)


def test_losses_of_all_pairs(spark):
    from tracelab.plans import trace_queries

    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").count().agg(F.sum((F.col("count") - 1) * (F.col("count") - 2) / 2)).first()[0]
    assert trace_queries.changepoint_loss(spark, "/root/testdata/sf0.001").count() == n


# Silhouettes

def test_silhouettes_shuffle_no_pairs(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (300, 8)), rng.normal(3, 1, (300, 8))]
    x[1] = x[0]  # products alone give copies a distance
    df = spark.createDataFrame([(v.tolist(), i // 300) for i, v in enumerate(x)], "v array<double>, label int")
    found = clustering.silhouettes(df.withColumn("features", array_to_vector("v")), ["label"])
    assert "Join [block" not in found._jdf.queryExecution().optimizedPlan().toString() and "Explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    away, own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.arange(600) // 300
    a = np.where(own == 0, away[:, :300].sum(axis=1), away[:, 300:].sum(axis=1)) / 299
    b = np.where(own == 1, away[:, :300].mean(axis=1), away[:, 300:].mean(axis=1))
    assert found.first()["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)


def test_labels_alone_take_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(clustering, "silhouettes", None)
    df = spark.createDataFrame([(float(i % 2), float(i % 7)) for i in range(40)], "a double, b double")
    out, scores = clustering.clustered(clustering.standardised(df, ["a", "b"]), range(2, 3), features="features", shapes=False)
    assert "label" in out.columns and [sorted(s) for s in scores] == [["bic", "k"]]


@pytest.mark.parametrize("block", [128, 7])
def test_silhouettes_equal_plain_loops(spark, monkeypatch, block):
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(0, 1, (25, 2)), rng.normal(4, 1, (20, 2)), [[9.0, 9.0]], [[0.0, 0.0]] * 2]
    labels = {"good": np.r_[np.zeros(25), np.ones(20), 5, 0, 0].astype(int), "random": rng.integers(0, 3, 48), "one": np.zeros(48, int)}
    rows = [(float(a), float(b), *(int(v[i]) for v in labels.values())) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, good int, random int, one int").repartition(3)
    got = {r["labelling"]: r["silhouette"] for r in clustering.silhouettes(df.withColumn("features", array_to_vector(F.array("a", "b"))), list(labels)).collect()}
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for name in ("good", "random"):
        each = []
        for i, own in enumerate(labels[name]):
            same = (labels[name] == own) & (np.arange(48) != i)
            if not same.any():
                each.append(0.0)
                continue
            a, b = away[i][same].mean(), min(away[i][labels[name] == k].mean() for k in set(labels[name]) - {own})
            each.append((b - a) / max(a, b))
        assert got[name] == pytest.approx(np.mean(each), abs=1e-12)
    assert got["one"] is None


@pytest.mark.parametrize("copies", [False, True])
def test_far_rows_are_summed_at_places(monkeypatch, copies):
    rng = np.random.default_rng(31)
    y = rng.uniform(0, 1, (8000, 2))
    y[:4000] = y[0] if copies else y[:4000]
    x = np.r_[y[((y > 0.4) & (y < 0.6)).all(axis=1)], rng.uniform(0.4, 0.6, (1500, 2))]
    cells = (y[:, 0] * 10).astype(int) * 10 + (y[:, 1] * 10).astype(int)
    of = np.stack([rng.integers(0, 3, 8000), 3 + (y[:, 0] * 4).astype(int)], axis=1)
    pairs, real = [], clustering._distances
    monkeypatch.setattr(clustering, "_distances", lambda a, b: pairs.append(len(a) * len(b)) or real(a, b))
    got = clustering._away(x, ((y[cells == c], of[cells == c]) for c in np.unique(cells)), 7)
    member = np.zeros((8000, 7))
    member[np.arange(8000)[:, None], of] = 1.0
    away = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)) @ member
    assert np.abs(got / away - 1).max() < 1e-12 and sum(pairs) < 0.6 * len(x) * len(y)


def test_silhouettes_of_a_plane_equal_all_pairs(spark):
    rng = np.random.default_rng(32)
    x = np.r_[rng.normal(0, 1, (1500, 2)), rng.normal(3, 0.1, (1200, 2)), [[40.0, -7.0]] * 300]
    labels = np.r_[np.zeros(1500), np.ones(1200), np.full(300, 5)].astype(int)
    rows = [([float(a), float(b)], int(k)) for (a, b), k in zip(x, labels, strict=True)]
    df = spark.createDataFrame(rows, "v array<double>, label int").repartition(5)
    from pyspark.ml.functions import array_to_vector

    got = clustering.silhouettes(df.withColumn("features", array_to_vector("v")), ["label"]).first()["silhouette"]
    away, own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.searchsorted([0, 1, 5], labels)
    sums, sizes = np.stack([away[:, own == k].sum(axis=1) for k in range(3)], axis=1), np.bincount(own)
    a, means = sums[np.arange(3000), own] / (sizes[own] - 1), sums / sizes
    means[np.arange(3000), own] = np.inf
    assert got == pytest.approx(((means.min(axis=1) - a) / np.maximum(means.min(axis=1), a)).mean(), abs=1e-12)


# Mixtures of all numbers of clusters

def test_mixtures_share_their_rounds(spark):
    def jobs_so_far():
        spark.sparkContext.setJobGroup("marks", "")
        try:
            spark.sparkContext.parallelize([1], 1).count()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup("marks"))

    x = np.random.default_rng(21).normal(0, 1, (300, 2))
    df = clustering.standardised(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"]).persist()
    before = jobs_so_far()
    clustering.clustered(df, range(2, 8), features="features", shapes=False)
    assert jobs_so_far() - before < 200  # 474 when each number of clusters has rounds of its own


def test_mixtures_equal_those_of_spark(spark):
    from pyspark.ml.clustering import GaussianMixture

    rng = np.random.default_rng(22)
    x = np.r_[rng.normal(0, 1, (150, 3)), rng.normal(2, 0.5, (100, 3))]
    df = clustering.standardised(spark.createDataFrame(x.tolist(), "a double, b double, c double"), list("abc")).persist()
    starts, models = [], []
    for k in (2, 4):
        first = GaussianMixture(k=k, seed=1, maxIter=0, featuresCol="features").fit(df)
        starts.append(clustering.Mixture(np.array(first.weights), *(np.array([getattr(g, c).toArray() for g in first.gaussians]) for c in ("mean", "cov"))))
        models.append(GaussianMixture(k=k, seed=1, featuresCol="features").fit(df))
    found = clustering.fitted(df.repartition(3), starts)
    for model, (mixture, likely, rounds) in zip(models, found, strict=True):
        assert rounds == model.summary.numIter and likely == pytest.approx(model.summary.logLikelihood, abs=1e-6)
        assert np.allclose(mixture.weights, model.weights, atol=1e-8) and np.allclose(mixture.means, [g.mean.toArray() for g in model.gaussians], atol=1e-8)
        assert np.allclose(mixture.covariances, [g.cov.toArray() for g in model.gaussians], atol=1e-8)
    a = clustering.clustered(df, range(2, 3), features="features", shapes=False)[0].toPandas()
    again = models[0].transform(spark.createDataFrame([(v,) for v in a["features"]], ["features"])).collect()
    assert len(a) == 250 and a["label"].tolist() == [r["prediction"] for r in again]


def test_rows_are_spread_over_files(spark):
    from tracelab.session import spread

    one = spark.range(1000).repartition(1)
    out = spread(one, 300)
    assert len(out.inputFiles()) == 4 and sorted(r["id"] for r in out.collect()) == list(range(1000))

"""Operators against known truth, plain numpy, and odd inputs."""

import math
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelab.functions import projections as P
from tracelab.operators import changepoint, clustering, features, generate, imaging, mixture, reshape, spectral, stats, windows
from tracelab.plans import plots
from tracelab.sources import frames, sheets, sinks
from tracelab.streaming.blocks import time_blocks


def trace(spark, x, trace_id=1):
    return spark.createDataFrame([(trace_id, i, None if v is None else float(v)) for i, v in enumerate(x)], "trace_id long, idx long, x double")


@pytest.fixture(scope="module")
def noisy(spark):
    return generate.ramp_trace(spark, (20.0, 70.0), (400, 1000), 1000, 5.0, seed=3).cache()


# Windows

def test_stretches_don_t_show(spark):
    x = np.random.default_rng(0).normal(size=200)
    rows = windows.framed(trace(spark, x), 6, 0, {"m": lambda w: F.avg("x").over(w)}, stretch=16).orderBy("idx").toPandas()
    want = [x[max(0, i - 6) : i + 1].mean() for i in range(200)]
    np.testing.assert_allclose(rows["m"], want)
    ahead = windows.framed(trace(spark, x), 0, 5, {"m": lambda w: F.sum("x").over(w)}, stretch=7).orderBy("idx").toPandas()
    np.testing.assert_allclose(ahead["m"], [x[i : i + 6].sum() for i in range(200)])


def test_running_values_are_carried_over_stretches(spark):
    x = np.random.default_rng(1).normal(size=60)
    x[20:45] = 9.0
    got = windows.running_sums(trace(spark, x), {"s": F.col("x"), "q": F.col("x") * F.col("x")}, stretch=7).orderBy("idx").toPandas()
    np.testing.assert_allclose(got["s"], np.cumsum(x), atol=1e-12)
    np.testing.assert_allclose(got["q"], np.cumsum(x * x), atol=1e-12)
    fixed = windows.repaired(trace(spark, x), -5, 5, stretch=7).orderBy("idx").toPandas()["x"]
    np.testing.assert_allclose(fixed, np.r_[x[:20], np.full(25, x[19]), x[45:]])
    assert windows.repaired(trace(spark, [9, 1, 9]), 0, 5, stretch=1).orderBy("idx").toPandas()["x"].fillna(-1).tolist() == [-1, 1, 1]
    rows = trace(spark, x).withColumn("day", F.floor(F.col("idx") / 11))
    assert windows.indexed(rows, "trace_id", ["idx"], "no", F.col("day")).filter("no <> idx").isEmpty()


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        windows.moving_average(trace(spark, [1]), 2, "silding")


def test_spread_with_few_positive_values(spark):
    out = windows.brownian_motion(trace(spark, [1, 0, -1, 0, 5, 7]), 3).orderBy("idx").toPandas()
    assert out["bm"].isna().tolist() == [True, True, True, False] and out["bm"].iloc[3] == pytest.approx(math.sqrt(2))


def test_gapped_block_mean_drops_the_last_row(spark):
    out = windows.gapped_block_mean(trace(spark, [1, 3, None, 5, None, None, 9]), 4).orderBy("block").toPandas()
    assert out["mean"].iloc[0] == 3 and math.isnan(out["mean"].iloc[1])


def test_lag_differences_on_truncated_length(spark):
    out = windows.lag_differences(trace(spark, range(11)), 3)
    assert out.count() == 6 and out.filter("dx <> 3").isEmpty()


def test_connected_adds_closing_levels(spark):
    both = trace(spark, [1, 2, 3], 1).union(trace(spark, [10, 10], 2))
    assert windows.connected(both, 2).orderBy("trace_id", "idx").toPandas()["x"].tolist() == [1, 2, 3, 12.5, 12.5]


# Statistics

def test_histograms(spark):
    x = np.random.default_rng(1).exponential(size=500)
    h = stats.histogram(trace(spark, x), 9).orderBy("bin").toPandas()
    count, edge = np.histogram(x, 9)
    assert h["count"].tolist() == count.tolist() and np.allclose(h["center"], (edge[1:] + edge[:-1]) / 2) and h["share"].sum() == pytest.approx(1)
    w = stats.width_histogram(trace(spark, [0.5, 1.5, 2.5, 9.9]), 1.0, 0.0, 3.0).toPandas()
    assert w["count"].sum() == 3
    assert stats.histogram(trace(spark, [2, 2, 2]), 3).agg(F.sum("count")).first()[0] == 3


def test_survival_is_monotone(spark):
    s = stats.survival(trace(spark, [3, 1, 1, 2, 5])).orderBy("value").toPandas()
    np.testing.assert_allclose(s["survival"], [0.6, 0.4, 0.2, 0])


def test_best_ignores_nan(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 2.0)], "k int, score double")
    assert stats.best(rows, [], "k", "score").first()["k"] == 3


def test_ratio_and_nan(spark):
    row = spark.createDataFrame([(1.0, 0.0, float("nan"), float("inf"))], "a double, b double, n double, i double").select(P.ratio("a", "b").alias("r"), P.or_zero("n").alias("n"), P.or_zero("i").alias("i"), P.ratio("i", "a").alias("big")).first()
    assert row["r"] is None and row["n"] == 0 and row["i"] > 1e308 and row["big"] == 0


# Mixtures

def test_single_exponential_is_the_mean(spark):
    d = generate.dwell_sample(spark, 500, [4.0])
    fit = mixture.fit_mixture(d, "exp", 1)[0]
    mean, n = d.agg(F.avg("x"), F.count("*")).first()
    assert fit.params["tau"][0] == pytest.approx(mean) and fit.ln_likelihood == pytest.approx(-n * math.log(mean) - n)


def test_gauss_mixture_recovers_four_components(spark):
    d = generate.gauss_sample(spark, 200, [6, 12, 18, 24], [1, 1, 1, 1], seed=5)
    fit = mixture.fit_mixture(d, "gauss", 4, tolerance=1e-4, least_sigma=0.2)[0]
    p = fit.ordered()
    np.testing.assert_allclose(p["m"], [6, 12, 18, 24], atol=0.4)
    assert sum(p["f"]) == pytest.approx(1) and fit.converged


def test_likelihood_never_falls(spark):
    d = generate.dwell_sample(spark, 300, [0.5, 4.0]).cache()
    found = [mixture.fit_mixture(d, "exp", 2, tolerance=0, least=n, most=n)[0].ln_likelihood for n in (1, 3, 9)]
    assert found == sorted(found)


def test_joint_mixture_and_labels(spark):
    a = generate.gauss_sample(spark, 400, [5.0], [1.0], 1).withColumn("t", generate.dwell(11, 0.5))
    b = generate.gauss_sample(spark, 200, [12.0], [2.0], 2).withColumn("t", generate.dwell(12, 3.0))
    fit = mixture.fit_mixture(a.union(b), "gauss_exp", 2, tolerance=1e-3, least_sigma=0.3)[0]
    p = fit.ordered()
    np.testing.assert_allclose(p["m"], [5, 12], atol=0.5)
    np.testing.assert_allclose(p["tau"], [0.5, 3.0], rtol=0.3)
    labels = mixture.predict(a.union(b), fit)
    assert labels.filter(F.abs(F.col("x") - 5) < 1).select("label").distinct().count() == 1
    assert plots.component_curves(spark, fit, 0, 20).count() == 200 and plots.joint_surface(spark, fit, (0, 20), (0, 5), 10).count() == 100
    assert mixture.progress_rows(fit, a).count() == 2 * (len(fit.history) + 1)


def test_choice_of_components(spark):
    d = generate.gauss_sample(spark, 300, [5, 25], [1, 1], 7)
    best, _ = mixture.choose_components(d, "gauss", "BIC", 3, tolerance=1e-3, most=60, least_sigma=0.3)
    assert best == 2


def test_pinned_means_and_groups(spark):
    d = generate.gauss_sample(spark, 200, [5.0, 9.0], [1, 1], 8).withColumn("t", generate.dwell(5, 2.0)).withColumn("g", F.col("component"))
    fits = mixture.fit_mixture(d, "gauss_exp", 1, by=["g"], pinned=[6.0], most=20)
    assert len(fits) == 2 and all(f.params["m"] == [6.0] for f in fits)
    assert mixture.as_rows(fits, d, ["g"]).count() == 2


def test_coins(spark):
    tosses = spark.createDataFrame([(5, 5), (9, 1), (8, 2), (4, 6), (7, 3)], "heads int, tails int")
    a, b, _ = mixture.coin_mixture(tosses)
    assert a == pytest.approx(0.519583, abs=1e-5) and b == pytest.approx(0.796789, abs=1e-5)


# Change points

def test_trace_loss_matches_plain_sums(noisy):
    x = noisy.orderBy("idx").toPandas()["x"].to_numpy()
    short = np.array([1.0, np.nan, 2.0, 4.0, 5.0])
    losses = changepoint.TraceLosses([x, short, x])
    for t1, t2 in ((400, 1000), (10, 11), (500, 1999)):
        c1, c2 = x[:t1].mean(), x[t2:].mean()
        want = ((x[:t1] - c1) ** 2).sum() + ((x[t2:] - c2) ** 2).sum() + ((x[t1:t2] - np.linspace(c1, c2, t2 - t1)) ** 2).sum()
        got = losses(np.array([t1 + 0.4, 2, 50.0]), np.array([t2 + 0.2, 4, 40.0]))
        assert got[0] == pytest.approx(want) and got[1] == pytest.approx(2 * 0 + (2 - 1) ** 2 + (4 - 5) ** 2) and math.isnan(got[2])


def test_moves_of_the_published_formulas():
    g = [np.array([2.0]), np.array([-1.0]), np.array([3.0])]
    a, r, m, s = (changepoint.mover(n, 0.1, True) for n in ("AdaGrad", "RMSprop", "Momentum", "Adam"))
    squares = mean = speed = first = second = 0.0
    for k, x in enumerate(g, 1):
        squares, mean, speed = squares + x * x, 0.9 * mean + 0.1 * x * x, 0.9 * speed - 0.1 * x
        first, second = 0.9 * first + 0.1 * x, 0.999 * second + 0.001 * x * x
        want = -0.1 * x / np.sqrt(squares + 1e-8), -0.1 * x / np.sqrt(mean + 1e-8), speed, -0.1 * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        np.testing.assert_allclose([float(y.move(x)[0]) for y in (a, r, m, s)], [float(w[0]) for w in want], rtol=1e-12)


def test_all_pairs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(changepoint, "STRETCH", 7)
    x = np.random.default_rng(2).normal(size=40) + np.r_[np.zeros(15), np.arange(10), np.full(15, 10.0)]
    loss = changepoint.TraceLosses([x])
    pairs = [(a, b) for b in range(2, 40) for a in range(1, b)]
    best = min(pairs, key=lambda t: float(loss(np.array([t[0]]), np.array([t[1]]))[0]))
    got = changepoint.best_change_points(trace(spark, x)).first()
    assert (got["t1"], got["t2"]) == best and changepoint.candidate_losses(trace(spark, x)).count() == len(pairs)


def test_change_points_by_search_and_descent(spark, noisy):
    best = changepoint.refined_change_points(noisy).first()
    assert abs(best["t1"] - 400) < 15 and abs(best["t2"] - 1000) < 15
    scored = stats.zscore(noisy, [], "x")
    for method, rate in (("Momentum", 3.0), ("Adam", 3.0), ("AdaGrad", 30.0), ("RMSprop", 1.0)):
        r = changepoint.fit_change_points(scored, (350, 900), method, rate, fitted="z").first()
        assert abs(r["cp_1"] - 400) < 40 and abs(r["cp_2"] - 1000) < 40, method
        assert r["bm_initial"] == pytest.approx(20, abs=1.5) and r["bm_final"] == pytest.approx(70, abs=1.5)


def test_crossed_change_points_are_null(spark, noisy):
    assert changepoint.fit_change_points(noisy, (900, 100)).first()["cp_1"] is None
    with pytest.raises(ValueError):
        changepoint.descend(lambda a, b: a, np.ones((2, 1)), "Newton")


def test_cubic_descents(spark):
    x = -9 + 0.05 * np.arange(340)
    exact = spark.createDataFrame(list(zip(x.tolist(), (10 * x + 3 * x**2 + x**3).tolist(), strict=True)), "x double, y double")
    np.testing.assert_allclose(changepoint.cubic_exact(exact), [10, 3, 1], atol=1e-6)
    p, _ = changepoint.cubic_descent(exact)
    np.testing.assert_allclose(p, [10, 3, 1], atol=0.7)
    noisy_y = 10 * x + 3 * x**2 + x**3 + np.random.default_rng(0).normal(0, 30, 340)
    rows = spark.createDataFrame(list(zip(x.tolist(), noisy_y.tolist(), strict=True)), "x double, y double")
    np.testing.assert_allclose(changepoint.cubic_minibatch(rows), changepoint.cubic_exact(rows), atol=1.0)
    p, _ = changepoint.cubic_descent(rows, standard=True, tolerance=1e-6)
    np.testing.assert_allclose(p, changepoint.cubic_exact(rows), atol=0.01)


def test_batches_stream_past_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 9), float(i)) for i in range(90)], "x double, y double")
    want = changepoint.cubic_minibatch(rows, batch=8, epochs=3)
    monkeypatch.setattr(changepoint, "HELD_BATCHES", 2)
    np.testing.assert_allclose(changepoint.cubic_minibatch(rows, batch=8, epochs=3), want, rtol=1e-9)


def test_epochs_send_no_batches_to_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 9), float(i)) for i in range(90)], "x double, y double")
    monkeypatch.setattr(changepoint, "HELD_BATCHES", 2)
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    assert np.isfinite(changepoint.cubic_minibatch(rows, batch=8, epochs=3)).all()


# Spectra

def test_staircase_spectrum_peaks_at_its_step(spark):
    steps = generate.staircase(spark, [(10.0, 0.2, 0.3)], 60, 100.0, 0.2, seed=2)
    acf = spectral.spatial_acf(steps, 2.0)
    s = spectral.power_spectrum(acf, 2.0).orderBy("k").toPandas()
    half = s[(s["freq"] > 0.05) & (s["freq"] < 1)]
    assert half.loc[half["psd"].idxmax(), "freq"] == pytest.approx(0.1, abs=0.02)


def test_power_spectrum_is_the_fft(spark):
    v = np.random.default_rng(4).random(12)
    acf = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "lag long, acf double")
    np.testing.assert_allclose(spectral.power_spectrum(acf, 1.0).orderBy("k").toPandas()["psd"], np.abs(np.fft.fft(v)), atol=1e-9)


def test_lag_variance_of_a_line(spark):
    c = spectral.lag_variance(trace(spark, np.arange(50) * 2.0), [1, 4]).orderBy("m").toPandas()
    np.testing.assert_allclose(c["mean_x"], [2, 8])
    np.testing.assert_allclose(c["var_x"], 0, atol=1e-9)
    assert spectral.lag_grid(0.05, 0.25, 0.05, 20) == [1, 2, 3, 4]


def test_expected_slope(spark):
    s = spark.createDataFrame([(5.0, 0.5, 10.0), (10.0, 1.0, 10.0)], "step double, tau double, n double")
    assert spectral.expected_slope(s).first()[0] == pytest.approx(75)


# Images

def test_spot_fit_finds_the_centre():
    image, _ = imaging.spot(np.array([42, 2.3, 2.6, 10.5, 11.6, 10, 6.5]), 20)
    p, ss, ok = imaging.fit_spot(image.reshape(20, 20), 6.5)
    assert ok and ss < 1e-6 and np.allclose(p[3:5], [10.5, 11.6], atol=1e-3)
    noisy = image.reshape(20, 20) + np.random.default_rng(0).normal(0, 5, (20, 20))
    assert np.allclose(imaging.fit_spot(noisy, 6.5)[0][3:5], [10.5, 11.6], atol=0.3)
    assert not imaging.fit_spot(np.full((20, 20), 5.0), 5.0)[2]


def test_spot_derivatives():
    p = np.array([42, 2.3, 2.6, 10.5, 11.6, 10, 6.5])
    f, j = imaging.spot(p, 20)
    for k in range(7):
        q = p.copy()
        q[k] += 1e-6
        np.testing.assert_allclose((imaging.spot(q, 20)[0] - f) / 1e-6, j[:, k], atol=1e-3)


def test_localize_and_points(spark):
    y, x = np.mgrid[:80, :80]
    image = sum(200 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 18) for a, b in ((25, 30), (55, 50)))
    rows = spark.createDataFrame([(1, 80, 80, image.ravel().tolist())], "image_id long, h int, w int, pixels array<double>")
    found = imaging.localize(rows, margin=5).orderBy("x").toPandas()
    assert len(found) == 2 and np.allclose(found[["x", "y"]], [[25, 30], [55, 50]], atol=0.7)
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 9.0, 9.0), (4, 9.0, 9.0)], "point_id long, x double, y double")
    assert sorted(r[0] for r in imaging.far_apart(pts, 1.0).select("point_id").collect()) == [3, 4]
    assert sorted(r[0] for r in imaging.spread_out(pts, 1.0).select("point_id").collect()) == [1, 3]


def test_points_of_dense_spots(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.uniform(-30, 30, (200, 2)), rng.normal(0, 0.3, (100, 2)), np.repeat(rng.uniform(-20, 20, (3, 2)), 4, axis=0)])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "point_id long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = [i for i in range(len(xy)) if not ((d[i] > 0) & (d[i] <= 2.0)).any()]
    assert sorted(r["point_id"] for r in imaging.far_apart(pts, 2.0).collect()) == want
    whole = imaging.spread_out(pts, 4.0)
    by_image = imaging.spread_out(pts.withColumn("image", F.lit(1)), 4.0, ["image"])
    assert sorted(r["point_id"] for r in whole.collect()) == sorted(r["point_id"] for r in by_image.collect())
    assert imaging.spread_out(pts.filter("false"), 4.0).count() == 0


def test_tracking_marks_failures(spark):
    rows = spark.createDataFrame([(0, 30, 30, [5.0] * 900)], "frame_id long, h int, w int, pixels array<double>")
    beads = spark.createDataFrame([(0, 15.0, 15.0), (1, 2.0, 2.0)], "aoi int, x double, y double")
    out = imaging.track(rows, beads, 20, 5.0).toPandas()
    assert len(out) == 2 and not out["fit_ok"].any() and (out["amplitude"] == 0).all()


# Sources and sinks

def test_frames_of_two_files(spark, tmp_path):
    for k, n in enumerate((3, 2)):
        (tmp_path / f"{k}.glimpse").write_bytes(np.arange(100 * k, 100 * k + 6 * n, dtype=">i2").tobytes() + b"x")
    (tmp_path / "empty.glimpse").write_bytes(b"")
    files = frames.list_files(spark, str(tmp_path))
    read = frames.read_frames(frames.frame_layout(files, 12), 2, 3, deep=True).orderBy("frame_id").toPandas()
    assert read["frame_id"].tolist() == [0, 1, 2, 3, 4]
    assert sorted(p[0] for p in read["pixels"]) == [0, 6, 12, 100, 106]
    (tmp_path / "h.txt").write_text("frames\t5\nwidth\t3\nheight\t2\nfps\t20.5\ndepth\t1\n")
    assert frames.read_header(spark, str(tmp_path / "h.txt")).first().asDict() == {"frames": 5, "width": 3, "height": 2, "fps": 20.5, "pixeldepth": 1}


def test_csv_sheets(spark, tmp_path):
    (tmp_path / "wild").mkdir()
    (tmp_path / "wild" / "a.csv").write_text("-1,50,nan\n0,51,60\n1,,61\n")
    t = sheets.read_trace_folder(spark, str(tmp_path)).orderBy("trace_id", "t").toPandas()
    assert t["label"].unique().tolist() == ["wild"] and t["x"].tolist() == [50, 51, 60, 61]


def test_a_sheet_of_more_traces_than_a_pivot_takes(spark, tmp_path):
    rows = spark.range(10_050).select(F.lit(0.5).alias("t"), F.col("id").alias("place"), (F.col("id") / 4).alias("x")).filter("place % 3 <> 0")
    sinks.write_trace_sheet(rows, str(tmp_path), "wild")
    back = sheets.read_trace_folder(spark, str(tmp_path)).toPandas()
    assert len(back) == 6700 and (back["x"] == back["trace_id"] / 4).all() and set(back["label"]) == {"wild"} and set(back["t"]) == {0.5}


def test_workbook_blocks(spark, tmp_path):
    cell = lambda r, c, v: f'<c r="{c}{r}"><v>{v}</v></c>'
    rows = "".join(f'<row r="{r}">{cell(r, "A", (r - 1) / 10)}{cell(r, "B", r * 2)}{cell(r, "E", (r - 1) / 5)}{cell(r, "F", r * 3) if r < 3 else ""}</row>' for r in (1, 2, 3))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    cells = sheets.read_workbooks(spark, str(tmp_path))
    t = sheets.block_traces(cells).orderBy("trace_id", "idx").toPandas()
    assert t["x"].tolist() == [2, 4, 6, 3, 6] and t["fs"].round(6).tolist() == [10, 10, 10, 5, 5]
    assert sheets.matrix_traces(cells, "S").count() == 11


def mat(arrays):
    def element(kind, raw):
        return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    def matrix(name, a):
        head = element(6, struct.pack("<II", 1 if isinstance(a, list) else 6, 0))
        shape = (len(a), len(a[0])) if isinstance(a, list) else a.shape
        body = head + element(5, struct.pack("<ii", *shape)) + element(1, name.encode())
        if isinstance(a, list):
            for c in range(shape[1]):
                for r in range(shape[0]):
                    body += matrix("", a[r][c])
        else:
            body += element(9, a.astype("<f8").tobytes(order="F"))
        return element(14, body)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for k, (name, a) in enumerate(arrays.items()):
        raw = matrix(name, a)
        out += struct.pack("<II", 15, len(z := zlib.compress(raw))) + z if k == 0 else raw
    return out


def test_books_and_arrays_in_parts(spark, tmp_path):
    cells = spark.range(35).select(F.lit(0).alias("book"), F.lit("S").alias("sheet"), F.floor(F.col("id") / 7).alias("row"), (F.col("id") % 7).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    made = sinks.write_workbooks(sinks.in_parts(cells, 2, 3), f"{tmp_path}/books", "run").collect()
    assert len(made) == 9 and max(r["cells"] for r in made) == 6
    back = sheets.whole_books(sheets.read_workbooks(spark, f"{tmp_path}/books")).toPandas()
    assert back["path"].nunique() == 1 and (back["value"] == 7 * back["row"] + back["col"]).all() and len(back) == 35
    pairs = spark.range(10).select(F.lit("a").alias("file"), F.explode(F.array(F.lit("step"), F.lit("dwell"))).alias("name"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("id").alias("at"), F.col("id").cast("double").alias("value"))
    assert sinks.write_mats(sinks.mat_parts(pairs, 4), f"{tmp_path}/mats", "run").count() == 3
    t = sheets.step_dwell(sheets.whole_mats(sheets.read_mat(spark, f"{tmp_path}/mats"))).orderBy("i").toPandas()
    assert t["i"].tolist() == t["step"].tolist() == t["dwell"].tolist() == list(range(10)) and t["path"].nunique() == 1


def test_mat_files(spark, tmp_path):
    (tmp_path / "1uM.mat").write_bytes(mat({"step": np.array([[5.0, 6.0, 20.0]]), "dwell": np.array([[0.5, 0.7, 0.9]])}))
    pairs = sheets.step_dwell(sheets.read_mat(spark, str(tmp_path)))
    assert features.short_steps(pairs).orderBy("i").toPandas()[["step", "dwell"]].to_numpy().tolist() == [[5, 0.5], [6, 0.7]]
    e = np.zeros((1, 0))
    (tmp_path / "fret.mat").write_bytes(mat({"Transmat": [[e, np.array([[1.0, 2.0]])], [np.array([[3.0]]), e]]}))
    t = sheets.transitions(sheets.read_mat(spark, str(tmp_path), "fret.mat")).orderBy("dwell").toPandas()
    assert t["way"].tolist() == ["off", "off", "on"] and t["dwell"].tolist() == [1, 2, 3]


def test_sinks_split_all_beads(spark, tmp_path):
    rows = spark.createDataFrame([(s, a, i, float(a + i)) for s in ("x", "y") for a in (1, 2, 3) for i in range(4)], "sheet string, aoi int, idx long, value double")
    passing = spark.createDataFrame([(2,)], "aoi int")
    one, other = sinks.write_split(rows, passing, str(tmp_path), "run")
    a, b = spark.read.parquet(one), spark.read.parquet(other)
    assert a.count() == 8 and b.count() == 16 and set(r[0] for r in a.select("aoi").distinct().collect()) == {2}
    fits = spark.createDataFrame([("p", 0, 1.0, 2.0), ("p", 1, 0.5, 3.0), ("q", 0, 1.0, 4.0)], "file string, component int, f double, tau double")
    wide = sinks.fit_sheet(fits, "file", ["f", "tau"], 2).orderBy("file").toPandas()
    assert wide["component_tau_1"].tolist() == [3, 0]


def test_fit_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f, 0, *([0.0] * 10 if f else [1.0] * 10)) for f in range(3)], sheets.FIT_RESULTS)
    path = sinks.write_fit_results(rows, str(tmp_path), "run")
    back = sheets.read_fit_results(spark, path, 2)
    assert back.count() == 2 and back.filter("fit_ok").count() == 1


# Clusters, reshapes, streams

def test_clusters_of_two(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(9, 1, (60, 3))])
    df = spark.createDataFrame(pd.DataFrame(v, columns=["a", "b", "c"]).assign(i=range(120)))
    out, scores = clustering.clustered(clustering.projected(clustering.standardised(df, ["a", "b", "c"])), range(2, 4))
    assert len(scores) == 2 and out.groupBy((F.col("i") < 60).alias("h")).agg(F.count_distinct("label").alias("n")).count() == 2


def test_bootstrap_draws_the_same_again(spark):
    t = trace(spark, [1, 2], 1).union(trace(spark, [3], 2))
    ids = spark.createDataFrame([(1, 0), (2, 1)], "trace_id long, ordinal long")
    a, b = (reshape.resampled(t, ids, 5, 9).orderBy("draw", "idx").collect() for _ in range(2))
    assert a == b and len({r["draw"] for r in a}) == 5


def test_block_columns_and_time(spark):
    wide = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0, 0.0, 5.0), (0.1, 2.0, 0.0, 0.0, 0.1, float("nan"))], ["t0", "x0", "u", "v", "t1", "x1"])
    assert reshape.block_columns(wide).orderBy("trace_id", "t").toPandas()["x"].tolist() == [1, 2, 5]
    times = spark.createDataFrame([(1, 7.5)], "idx long, t double")
    assert reshape.timed(trace(spark, [1, 1]), 2.0, times).orderBy("idx").toPandas()["t"].tolist() == [0, 7.5]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS trace_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id, 0, 0) AS ts, cast(id AS double) AS x FROM range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = time_blocks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    same = time_blocks(rows).exceptAll(spark.table("blocks"))
    assert same.isEmpty() and spark.table("blocks").agg(F.sum("n")).first()[0] == 100


def test_empty_tables(spark):
    none = trace(spark, [])
    assert windows.moving_average(none, 3).count() == 0 and windows.brownian_motion(none, 3).count() == 0
    assert stats.survival(none).count() == 0 and stats.zscore(none, [], "x").count() == 0
    assert changepoint.best_change_points(none).count() == 0
    assert mixture.fit_mixture(none, "exp", 2, by=["trace_id"]) == []

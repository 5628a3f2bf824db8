"""Whole analyses on simulated data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import generate
from tracelab.plans import pipelines


def test_reaction_velocities(spark):
    good = generate.ramp_trace(spark, (58.0, 20.0), (3000, 7000), 3000, 2.0, seed=1, trace=1)
    bad = generate.ramp_trace(spark, (30.0, 20.0), (3000, 7000), 3000, 2.0, seed=2, trace=2)
    rows = good.union(bad).withColumn("t", (F.col("idx") - 500) / 20.0)
    out = pipelines.reaction_velocities(rows, 20, fps=20.0, start=(130, 370), method="Momentum", rate=1.0).toPandas()
    assert out["trace_id"].tolist() == [1]
    assert out["cp_1"].iloc[0] == pytest.approx(150, abs=15) and out["bm_final"].iloc[0] == pytest.approx(20, abs=1)
    assert out["velocity_per_min"].iloc[0] == pytest.approx(-38 / 200 * 60, rel=0.15)


def test_video_to_features(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:120, :120]
    centres, rows = [(45.0, 50.0), (80.0, 75.0)], []
    for f in range(30):
        image = 10 + rng.normal(0, 1, (120, 120))
        for a, b in centres:
            dx, dy = rng.normal(0, 0.5, 2)
            image += 150 * np.exp(-((x - a - dx) ** 2 + (y - b - dy) ** 2) / (2 * 2.5**2))
        rows.append((f, 120, 120, np.clip(image, 0, 255).ravel().tolist()))
    frames = spark.createDataFrame(rows, "frame_id long, h int, w int, pixels array<double>").repartition(4).cache()
    beads = pipelines.bead_centres(frames, 30, black=20).toPandas()
    assert len(beads) == 2 and np.allclose(beads[["x", "y"]], centres, atol=0.5)
    tracks, found, attributes, passing = pipelines.video_features(frames, spark.createDataFrame(beads), 10.0, 10, 1.0, background=10.0, bounds=(0.1, 2.0))
    assert tracks.filter("fit_ok").count() == 60
    med = attributes.filter("sheet = 'BMx_sliding'").toPandas()["med"]
    assert np.allclose(med, 0.5, atol=0.25) and found.select("sheet").distinct().count() == 8
    assert passing.count() <= 2


def test_step_dwell_and_transitions(spark):
    a = generate.gauss_sample(spark, 300, [5.0], [1.5], 1).select(F.col("x").alias("step"), generate.dwell(7, 0.5).alias("dwell"), F.lit("1uM").alias("cond"))
    b = generate.gauss_sample(spark, 300, [8.0], [1.5], 2).select(F.col("x").alias("step"), generate.dwell(8, 2.0).alias("dwell"), F.lit("2uM").alias("cond"))
    out = pipelines.step_dwell_fits(a.union(b)).filter("fit = 'step_dwell'").orderBy("cond").toPandas()
    assert np.allclose(out["m"], [5, 8], atol=0.4) and np.allclose(out["tau"], [0.5, 2.0], rtol=0.2)
    assert pipelines.step_dwell_fits(a.union(b), None, components=2, pinned=[4.59, 8.13]).filter("fit = 'step_dwell'").toPandas()["m"].tolist() == [4.59, 8.13]
    d = generate.dwell_sample(spark, 400, [0.5, 15.0]).select(F.lit("on").alias("way"), F.col("x").alias("dwell"))
    fits = pipelines.transition_fits(d, ["way"], most=3).toPandas()
    assert fits["k"].unique().tolist() == [2] and np.allclose(fits["tau"], [0.5, 15.0], rtol=0.25)
    assert pipelines.transition_fits(d, ["way"], 3).count() == 3


def test_step_spectrum(spark):
    t = generate.staircase(spark, [(10.0, 0.2, 0.3)], 40, 100.0, 0.2, seed=2).union(generate.staircase(spark, [(10.0, 0.2, 0.3)], 40, 100.0, 0.2, seed=9, trace=1))
    s = pipelines.step_spectrum(t, draws=2).toPandas()
    assert {"freq", "psd", "smoothed"} <= set(s.columns) and len(s) > 100


def test_cluster_report(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(9 * (i % 2), 1, 2))) for i in range(80)]
    labelled, report = pipelines.cluster_report(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"], range(2, 4))
    assert labelled.count() == 80 and report.agg(F.sum("n")).first()[0] == 80

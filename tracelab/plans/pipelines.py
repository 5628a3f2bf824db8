"""Whole analyses composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.functions.projections import NM_PER_PIXEL
from tracelab.operators import changepoint, clustering, features, imaging, mixture, reshape, spectral, stats, windows

MARGIN = 30  #: pixels at the border of an image in which no bead is looked for


def reaction_velocities(traces: DataFrame, window: int = 20, low: float = 0.1, high: float = 80, fps: float = 1.0, start: tuple[float, float] | None = None, quality: dict | None = None, **descent) -> DataFrame:
    """Change points and velocities of good tethers: quality, block means, repair, scores, descent.

    ``traces`` has trace_id, idx, t, x. Traces whose change points cross have
    null results instead of stopping the rest.
    """
    good = reshape.selected(traces, features.tether_quality(traces, **(quality or {})), "trace_id")
    means = windows.gapped_block_mean(good, window).select("trace_id", F.col("block").alias("idx"), F.col("mean").alias("x"))
    whole = windows.repaired(means, low, high)
    scored = stats.zscore(whole, ["trace_id"], "x")
    return changepoint.fit_change_points(scored, start, fps=fps / window, fitted="z", **descent)


def bead_centres(frames: DataFrame, first: int = 50, distance: float = 20, size: int = 20, black: float | None = None, white: float | None = None, contrast: float = 1.0, low: float = 30, high: float = 90, margin: int = MARGIN, rounds: int = 2) -> DataFrame:
    """Beads of the mean of the first frames: aoi, x, y, amplitude.

    Outlines give centres; in each round near ones are thinned out, the rest
    refined by spot fits, and dark or bright spots left out.
    """
    few = frames.filter(F.col("frame_id") < first)
    image = imaging.mean_image(few, ["h", "w"]).withColumn("image_id", F.lit(0).cast("long"))
    background = image.agg(F.avg(imaging.mean(F.col("pixels")))).first()[0] or 0.0
    points = imaging.localize(image, contrast, low, high, margin).select("point_id", "x", "y")
    for _ in range(rounds):
        apart = imaging.spread_out(imaging.far_apart(points, distance / 2), distance)
        beads = apart.select(F.col("point_id").cast("int").alias("aoi"), "x", "y")
        fits = imaging.track(image.withColumn("frame_id", F.col("image_id")), beads, size, background)
        placed = fits.filter("fit_ok").withColumnsRenamed({"x": "fx", "y": "fy"}).join(beads, "aoi")
        shifted = placed.select(F.col("aoi").cast("long").alias("point_id"), (F.floor("x") - size // 2 + F.col("fx")).alias("x"), (F.floor("y") - size // 2 + F.col("fy")).alias("y"), "amplitude")
        found = features.amplitude_between(shifted, black, white)
        points = found.select("point_id", "x", "y")
    order = Window.orderBy(F.hypot("x", "y"), "point_id")
    return found.select((F.row_number().over(order) - 1).cast("int").alias("aoi"), "x", "y", "amplitude")


def video_features(frames: DataFrame, beads: DataFrame, fps: float, window: int = 20, factor: float = NM_PER_PIXEL, size: int = 20, background: float = 0.0, bounds: tuple[float, float] = (0.0, float("inf"))) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tracks of all beads, their features, their attributes, and the beads that pass."""
    tracks = imaging.track(frames, beads, size, background)
    rows = reshape.timed(tracks.withColumn("idx", F.col("frame").cast("long")), fps)
    found = features.bead_features(rows, window, factor)
    attributes = features.bead_attributes(found, fps)
    return tracks, found, attributes, features.passing_beads(attributes, *bounds)


def step_dwell_fits(events: DataFrame, condition: str | None = "cond", limit: float = 15, components: int = 1, pinned: list[float] | None = None) -> DataFrame:
    """Dwell and joint step-dwell mixtures: of each condition, or of all together without one.

    ``events`` has step and dwell. Rows of the two kinds of fit are told apart by ``fit``.
    """
    by = [condition] if condition else []
    kept = features.short_steps(events, limit).select(*by, F.col("step").alias("x"), F.col("dwell").alias("t"))
    dwell = kept.select(*by, F.col("t").alias("x"))
    parts = [mixture.as_rows(mixture.fit_mixture(dwell, "exp", components, by=by), dwell, by).withColumn("fit", F.lit("dwell")), mixture.as_rows(mixture.fit_mixture(kept, "gauss_exp", components, by=by, pinned=pinned), kept, by).withColumn("fit", F.lit("step_dwell"))]
    return reshape.stacked(parts)


def transition_fits(dwells: DataFrame, by: list[str], components: int | None = None, most: int = 5) -> DataFrame:
    """Dwell mixtures of each kind of transition, with a given number of components or the one of least BIC."""
    fits = mixture.fit_mixture(dwells.select(*by, F.col("dwell").alias("x")), "exp", components or list(range(1, most + 1)), by=by)
    if components is None:
        chosen: dict[tuple, mixture.Fit] = {}
        for f in fits:
            if f.ln_likelihood is not None and (f.group not in chosen or f.bic() < chosen[f.group].bic()):
                chosen[f.group] = f
        fits = list(chosen.values())
    return mixture.as_rows(fits, dwells.withColumn("x", F.col("dwell")), by)


def step_spectrum(traces: DataFrame, spatial_rate: float = 2.0, draws: int | None = None, seed: int = 0, smooth: int = 5) -> DataFrame:
    """Power spectrum of traces put end to end, bootstrapped if ``draws`` are asked for: freq, psd, smoothed."""
    if draws:
        ids = traces.select("trace_id").distinct()
        traces = reshape.resampled(traces, windows.numbered(ids, ["trace_id"], "ordinal"), draws, seed).select(F.col("draw").alias("trace_id"), "idx", "x")
    s = spectral.position_spectrum(windows.connected(traces), spatial_rate)
    rows = s.select(F.lit(0).alias("trace_id"), F.col("k").alias("idx"), "freq", "psd")
    return windows.moving_average(rows, smooth, value="psd").select(F.col("idx").alias("k"), "freq", "psd", F.col("ma").alias("smoothed"))


def cluster_report(beads: DataFrame, values: list[str], ks: range = range(2, 10)) -> tuple[DataFrame, DataFrame]:
    """Labelled beads, and the number, mean and deviation of each attribute in every cluster."""
    labelled, _ = clustering.clustered(clustering.projected(clustering.standardised(beads, values)), ks, shapes=False)
    return labelled, stats.group_sizes(labelled, "label", values)

"""Queries over ``operators.tapers``, on frames of 16 samples with three tapers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ternfield.operators import signal, tapers
from ternfield.plans.catalog import FRAME, query, wave

NFFT, ORDER = 16, 3
H, DH, _, T = tapers.hermite(NFFT - 1, ORDER)


def _rows(name: str, w: np.ndarray) -> str:
    """A table (w, k, <name>) of the windows' values."""
    cells = ", ".join(f"({j}, {k}, {float(x)!r}::DOUBLE)" for j, row in enumerate(w) for k, x in enumerate(row))
    return f"{name}_w AS (SELECT * FROM (VALUES {cells}) v(w, k, {name}))"


WAVES = (
    FRAME
    + f", {_rows('h', H)}, {_rows('dh', DH[:ORDER])}, {_rows('th', H * T)}"
    + """, fr AS (SELECT unnest(range(16))::INT AS f),
z AS (SELECT sig, t, f, w, sum(x * h * cos(k * f * pi() / 8)) AS hr, -sum(x * h * sin(k * f * pi() / 8)) AS hi, sum(x * dh * cos(k * f * pi() / 8)) AS dr, -sum(x * dh * sin(k * f * pi() / 8)) AS di,
sum(x * th * cos(k * f * pi() / 8)) AS gr, -sum(x * th * sin(k * f * pi() / 8)) AS gi FROM frame JOIN h_w USING (k) JOIN dh_w USING (w, k) JOIN th_w USING (w, k) CROSS JOIN fr GROUP BY 1, 2, 3, 4)"""
)


def _frames(spark, sf):
    return signal.frames(wave(spark, sf), nfft=NFFT, winsize=NFFT)


@query(f"WITH {WAVES} SELECT sig, t, f, round(sum(sqrt(hr * hr + hi * hi)) / 3, 5) AS v FROM z WHERE f < 9 GROUP BY 1, 2, 3")
def multitaper_spectrum(spark, sf):
    return tapers.multitaper(_frames(spark, sf), H, nfft=NFFT, bins=9).select("sig", "t", "f", F.round("v", 5).alias("v"))


def _derivatives(spark, sf):
    return tapers.derivatives(_frames(spark, sf), H, DH, T, nfft=NFFT, bins=NFFT)


@query(
    f"""WITH {WAVES}, q AS (SELECT sig, t, f, (dr * hr + di * hi) / (hr * hr + hi * hi) AS a, (gi * hr - gr * hi) / (hr * hr + hi * hi) AS b, (di * hr - dr * hi) / (hr * hr + hi * hi) AS c, (gr * hr + gi * hi) / (hr * hr + hi * hi) AS d FROM z WHERE f BETWEEN 1 AND 7)
SELECT sig, t, f, round(sum(a) / 3, 4) + 0e0 AS m_t, round(-sum(b) / 3, 4) + 0e0 AS m_w, round(sum(c) / 3, 4) + 0e0 AS p_t, round(-sum(d) / 3, 4) + 0e0 AS p_w FROM q GROUP BY 1, 2, 3"""
)
def phase_derivatives(spark, sf):
    """Derivatives of magnitude and phase; at frequency 0 and half the rate, where spectra are real, they are left out."""
    cols = [(F.round(c, 4) + 0.0).alias(c) for c in ("m_t", "m_w", "p_t", "p_w")]
    return _derivatives(spark, sf).where("f between 1 and 7").select("sig", "t", "f", *cols)


@query(None)
def phase_bits(spark, sf):
    i, j = np.mgrid[:8, :8]
    kernel = np.exp(-((i - 4) ** 2 + (j - 4) ** 2) / 4.0)
    return tapers.phase_bits(_derivatives(spark, sf), bins=NFFT, kernel=kernel, sigma=2.0).where(F.col("f") < 8)


G = np.exp(-((np.arange(7) - 3) ** 2) / 2)
G = G / G.sum()


def _smooth_sql(across: bool) -> str:
    """Spectra rounded to six places, so that engines agree on which are 0, then logarithms and smoothing."""
    at = lambda k, of: f"{'lag' if k >= 0 else 'lead'}(v, {abs(k)}) OVER ({of})"
    time = " + ".join(f"{x!r}::DOUBLE * coalesce({at(i - 3, 'PARTITION BY sig, f ORDER BY t')}, 0)" for i, x in enumerate(G.tolist()))
    freq = " + ".join(f"{x!r}::DOUBLE * {at(i - 6, 'PARTITION BY sig, t ORDER BY f')}" for i, x in enumerate(G.tolist()))
    source = f"(SELECT sig, t, f, {freq} AS v FROM lg)" if across else "lg"
    return f"""WITH {WAVES}, sp AS MATERIALIZED (SELECT sig, t, f, round(sum(sqrt(hr * hr + hi * hi)) / 3, 6) AS v FROM z WHERE f < 9 GROUP BY 1, 2, 3),
lg AS MATERIALIZED (SELECT sig, t, f, ln(CASE WHEN v = 0 THEN min(v) FILTER (WHERE v <> 0) OVER (PARTITION BY sig) ELSE v END) AS v FROM sp),
fs AS MATERIALIZED (SELECT * FROM {source} WHERE v IS NOT NULL) SELECT sig, t, f, round({time}, 4) + 0e0 AS v FROM fs"""


def _log_spectrum(spark, sf, across):
    spec = tapers.multitaper(_frames(spark, sf), H, nfft=NFFT, bins=9).withColumn("v", F.round("v", 6))
    return tapers.log_smooth(spec, length=7, across=across).select("sig", "t", "f", (F.round("v", 4) + 0.0).alias("v"))


@query(_smooth_sql(False))
def log_spectrum(spark, sf):
    return _log_spectrum(spark, sf, False)


@query(_smooth_sql(True))
def log_spectrum_across(spark, sf):
    """Smoothed over frequency too."""
    return _log_spectrum(spark, sf, True)


@query(None)
def wavelet_filters(spark, sf):
    """Filter, frequency and value of a bank of Morlet filters for windows of 64 samples, one an octave."""
    n = 64
    scales = tapers.octaves(n)
    c, s = tapers.centres(3 * np.pi / 4, 0.8, 0.8, scales, 1, 2)
    psi, phi = tapers.filter_bank(n, c, s, scales, 0.8 * 2 ** (scales - 1))
    bank = [*psi, phi]
    return spark.createDataFrame([(i, k, round(float(x), 9)) for i, row in enumerate(bank) for k, x in enumerate(row)], "filter int, k int, value double")


@query(None)
def wavelet_spectrum(spark, sf):
    """(sig, t, filter, v): magnitudes of a frame's spectrum summed under each filter of a bank of 16 places."""
    c, s = tapers.centres(3 * np.pi / 4, 0.8, 0.8, 2, 1, 1)
    psi, _ = tapers.filter_bank(NFFT, c, s, 2, 1.6)
    spec = tapers.multitaper(_frames(spark, sf), np.ones((1, NFFT)), nfft=NFFT, bins=NFFT)
    under = [F.struct(F.lit(i).alias("filter"), F.sum(F.col("v") * F.get(F.array(*[F.lit(abs(float(x))) for x in row]), F.col("f"))).alias("v")) for i, row in enumerate(psi)]
    out = spec.groupBy("sig", "t").agg(F.array(*under).alias("o")).select("sig", "t", F.explode("o").alias("o"))
    return out.select("sig", "t", "o.filter", F.round("o.v", 5).alias("v"))

"""Tapers, wavelet filters and the features from several spectra of one frame.

Tapers and filters are small arrays by parameters; they enter plans as literals. Frames are (sig, t, k, x).
"""

from __future__ import annotations

import math

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternfield.sources.scratch import written


def hermite(length: int, order: int, half_support: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tapers, first derivatives, second derivatives, times): Hermite functions sampled over +-half_support.

    Function k is H_k(t) exp(-t^2 / 2) / sqrt(sqrt(pi) 2^k k!), and its derivative t h_k - sqrt(2 (k + 1)) h_(k+1);
    all are scaled to the sampling step. An even length has one place less, and a zero at the end of each taper.
    """
    n = length - 1 + length % 2
    t = np.linspace(-half_support, half_support, n)
    step = 2 * half_support / (n - 1)
    # normalised recurrence: h_(k+1) = t sqrt(2 / (k + 1)) h_k - sqrt(k / (k + 1)) h_(k-1)
    h = [np.exp(-t * t / 2) / math.pi**0.25 * math.sqrt(step)]
    for k in range(order + 1):
        h.append(t * math.sqrt(2 / (k + 1)) * h[k] - (math.sqrt(k / (k + 1)) * h[k - 1] if k else 0.0))
    first = [(t * h[k] - math.sqrt(2 * (k + 1)) * h[k + 1]) * step for k in range(order + 1)]
    second = [(h[k] * step + t * first[k] - math.sqrt(2 * (k + 1)) * first[k + 1]) * step for k in range(order)]
    tapers = np.array(h[:order])
    return (np.pad(tapers, ((0, 0), (0, 1))) if length % 2 == 0 else tapers), np.array(first), np.array(second), t


def mirrored_tail(tapers: np.ndarray, extra: int) -> np.ndarray:
    """Tapers with their last ``extra`` places again, in reverse order, at the end."""
    return np.concatenate([tapers, tapers[..., ::-1][..., :extra]], axis=-1)


def octaves(support: float, per_octave: int = 1, bandwidth: float | None = None, low_ratio: float | None = None) -> int:
    """How many log-spaced wavelets it takes for the widest to span ``support`` samples."""
    ratio = low_ratio if low_ratio is not None else (2 if per_octave == 1 else 1)
    return 1 + int(math.log2(support * ratio / (4 * (bandwidth or per_octave))) * per_octave + 0.5)


def gabor(n: int, centre: float, sigma: float, radius: int = 1) -> np.ndarray:
    """A Gaussian around ``centre`` on n frequencies of the circle, summed over the periods -radius to radius + 1."""
    w = 2 * math.pi * (np.arange(n)[:, None] / n - np.arange(-radius, radius + 2)[None, :])
    return np.exp(-((w - centre) ** 2) * sigma**2 / 2).sum(1)


def morlet(n: int, centre: float, sigma: float) -> np.ndarray:
    """The Gabor filter without its response at frequency 0."""
    band = gabor(n, centre, sigma)
    return band - band[0] * gabor(n, 0.0, sigma)


def centres(top: float, sigma: float, sigma_low: float, scales: int, per_octave: int, linear: int, base_sigma: float = 2 / math.sqrt(3)) -> tuple[np.ndarray, np.ndarray]:
    """(centre frequencies, widths in time): ``scales`` log-spaced filters, then ``linear`` ones evenly down to the low pass."""
    j = np.arange(scales)
    c, s = top * 2.0 ** (-j / per_octave), sigma * 2.0 ** (j / per_octave)
    if linear:
        gap = math.pi * 2.0 ** (-scales / per_octave) * (1 - base_sigma / (4 * sigma_low) * 2.0 ** (1 / per_octave)) / linear
        c = np.concatenate([c, top * 2.0 ** ((1 - scales) / per_octave) - gap * np.arange(1, linear + 1)])
        s = np.concatenate([s, np.full(linear, sigma * 2.0 ** ((scales - 1) / per_octave))])
    return c, s


def filter_bank(n: int, c: np.ndarray, s: np.ndarray, log_spaced: int, sigma_low: float, *, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(band filters [filter, frequency], low pass): Morlet filters scaled so that the log-spaced ones' energy is at most 2.

    Values at or below ``threshold`` of a filter's largest are 0.
    """
    psi = np.array([morlet(n, x, y) for x, y in zip(c, s, strict=True)])
    energy = (np.abs(psi[:log_spaced]) ** 2).sum(0)
    psi = psi * math.sqrt(2 / energy.max())
    peak = np.abs(psi).max(1, keepdims=True)
    return np.where(np.abs(psi) > threshold * peak, psi, 0.0), gabor(n, 0.0, sigma_low)


def _waves(frames: DataFrame, windows: dict[str, np.ndarray], nfft: int, bins: int) -> DataFrame:
    """(sig, t, f, <name>: array of (re, im) by taper) of the frames under every window, in one aggregation a frame."""
    x, k = F.col("x"), F.col("k").cast("int")
    angle = [[2 * math.pi * f * i / nfft for i in range(nfft)] for f in range(bins)]
    samples = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), x.alias("x")))), lambda s: s["x"])
    by_frame = frames.groupBy("sig", "t").agg(samples.alias("s"))
    basis = F.array(*[F.struct(F.lit(f).alias("f"), F.array(*[F.lit(math.cos(a)) for a in row]).alias("c"), F.array(*[F.lit(-math.sin(a)) for a in row]).alias("s")) for f, row in enumerate(angle)])
    rows = by_frame.select("sig", "t", "s", F.explode(basis).alias("b"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    out = []
    for name, w in windows.items():
        padded = np.pad(w, ((0, 0), (0, max(0, nfft - w.shape[1]))))[:, :nfft]
        lit = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in padded])
        out.append(F.transform(lit, lambda row: F.struct(dot(F.zip_with(F.col("s"), row, lambda u, v: u * v), F.col("b.c")).alias("re"), dot(F.zip_with(F.col("s"), row, lambda u, v: u * v), F.col("b.s")).alias("im"))).alias(name))
    return rows.select("sig", "t", F.col("b.f").alias("f"), *out)


def _mean(parts: Column, n: int) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v) / n


def multitaper(frames: DataFrame, tapers: np.ndarray, *, nfft: int, bins: int) -> DataFrame:
    """(sig, t, f, v): the mean over the tapers of the magnitudes of each frame's spectrum."""
    size = F.transform("h", lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))
    return _waves(frames, {"h": tapers}, nfft, bins).select("sig", "t", "f", _mean(size, len(tapers)).alias("v"))


def derivatives(frames: DataFrame, tapers: np.ndarray, first: np.ndarray, times: np.ndarray, *, nfft: int, bins: int) -> DataFrame:
    """(sig, t, f, v, m_t, m_w, p_t, p_w): mean magnitude, and mean derivatives of log magnitude and of phase in time
    and in frequency, from the spectra under the tapers, their derivatives and the tapers times time.

    A taper under which a frame has no energy adds 0.
    """
    n = len(tapers)
    width = min(tapers.shape[1], first.shape[1], len(times))
    waves = _waves(frames, {"h": tapers[:, :width], "d": first[:n, :width], "g": tapers[:, :width] * times[:width]}, nfft, bins)

    def ratio(z: str) -> Column:
        """The quotient of the two spectra, by taper."""
        over = lambda a, b: F.coalesce(F.try_divide(a, b["re"] * b["re"] + b["im"] * b["im"]), F.lit(0.0))
        return F.zip_with(z, "h", lambda a, b: F.struct(over(a["re"] * b["re"] + a["im"] * b["im"], b).alias("re"), over(a["im"] * b["re"] - a["re"] * b["im"], b).alias("im")))

    size = F.transform("h", lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))
    part = lambda c, of, sign: sign * _mean(F.transform(c, lambda z: z[of]), n)
    quotients = waves.select("sig", "t", "f", _mean(size, n).alias("v"), ratio("d").alias("qd"), ratio("g").alias("qg"))
    return quotients.select("sig", "t", "f", "v", part("qd", "re", 1).alias("m_t"), part("qg", "im", -1).alias("m_w"), part("qd", "im", 1).alias("p_t"), part("qg", "re", -1).alias("p_w"))


def convolve(grid: DataFrame, columns: dict[str, tuple[str, np.ndarray]], *, bins: int) -> DataFrame:
    """(sig, t, f, <name>) for name -> (column, kernel): convolution in (t, f), with edges mirrored about the border.

    The kernel's centre is place size // 2, so that an even kernel reaches one place further back. A frame is a row of
    arrays, written once, and sent to the frames that need it: as many copies as the kernel has rows. What they add up
    to is a product with the kernels as matrices, in Arrow batches. Absent and null cells count as 0. Joins say that they
    merge: files of few distinct values look small enough to broadcast and fill the driver.
    """
    high, wide = next(iter(columns.values()))[1].shape
    cells, names = sorted({c for c, _ in columns.values()}), list(columns)
    values = F.collect_list(F.struct("f", *[F.col(c).cast("double").alias(c) for c in cells]))
    frames = written(grid.groupBy("sig", "t").agg(values.alias("cells")), "frames")
    sizes = frames.groupBy("sig").agg((F.max("t") + 1).cast("int").alias("frames"))
    turn = F.pmod(F.col("t") + high // 2 - F.col("i"), 2 * F.col("frames"))
    at = F.least(turn, 2 * F.col("frames") - 1 - turn)  # ... 1 0 | 0 1 2 | 2 1 ...
    need = frames.select("sig", "t", F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("i")).join(sizes.hint("merge"), "sig").select("sig", "t", "i", at.alias("at"))
    met = need.join(frames.withColumnRenamed("t", "at").hint("merge"), ["sig", "at"]).groupBy("sig", "t").agg(F.collect_list(F.struct("i", "cells")).alias("near"))
    maps = {}
    for name, (_, k) in columns.items():
        maps[name] = np.zeros((high, bins, bins))
        for f in range(bins):
            for j in range(wide):
                x = (f + wide // 2 - j) % (2 * bins)
                maps[name][:, min(x, 2 * bins - 1 - x), f] += k[:, j]
    maps = {name: m.reshape(high * bins, bins) for name, m in maps.items()}
    kind = T.StructType([grid.schema["sig"], grid.schema["t"], grid.schema["f"], *(T.StructField(n, T.DoubleType()) for n in names)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column("near")
            rows, of = near.flatten(), np.repeat(np.arange(len(b)), np.diff(near.offsets.to_numpy()))
            i, inner = rows.field("i").to_numpy(), rows.field("cells")
            cell, per = inner.flatten(), np.diff(inner.offsets.to_numpy())
            f = cell.field("f").to_numpy()
            row, i = np.repeat(of, per), np.repeat(i, per)
            there = np.zeros((len(b), bins), bool)
            own = i == high // 2  # a frame's own cells
            there[row[own], f[own]] = True
            dense = {}
            for c in cells:
                dense[c] = np.zeros((len(b), high, bins))
                dense[c][row, i, f] = pc.fill_null(cell.field(c), 0.0).to_numpy(zero_copy_only=False)
            r, f = np.nonzero(there)
            out = [pa.array((dense[c].reshape(len(b), -1) @ maps[n])[r, f]) for n, (c, _) in columns.items()]
            yield pa.RecordBatch.from_arrays([b.column("sig").take(pa.array(r)), b.column("t").take(pa.array(r)), pa.array(f).cast(b.schema.field("near").type.value_type.field("cells").type.value_type.field("f").type), *out], ["sig", "t", "f", *names])

    return met.mapInArrow(each, kind)


def phase_bits(phases: DataFrame, *, bins: int, kernel: np.ndarray, sigma: float, freq: float = 0.12, line: float = 0.05, time: float = 4.125, spread: int = 3) -> DataFrame:
    """(sig, t, f, channel): the binary channels that are on, from (sig, t, f, p_t, p_w).

    0: the phase's mixed derivative is above ``freq``. 1, 2, 3: channel 0, and near by on the diagonal, row or
    other diagonal lies a place whose second time derivative is above ``line``, within it, or below -``line``.
    4: the other mixed derivative is above ``time``. Nothing lies beyond the edges.
    """
    i, j = np.mgrid[: kernel.shape[0], : kernel.shape[1]]
    mid = (np.array(kernel.shape) - 1) / 2
    by_w, by_t = -(j - mid[1]) / sigma * kernel, -(i - mid[0]) / sigma * kernel
    smooth = convolve(phases, {"wt": ("p_t", by_w), "tt": ("p_t", by_t), "tw": ("p_w", by_t)}, bins=bins)
    state = F.when(F.abs("tt") > line, F.signum("tt")).otherwise(0.0).cast("int")
    marked = written(smooth.select("sig", "t", "f", (F.col("wt") > freq).alias("on"), (F.col("tw") > time).alias("late"), state.alias("state")), "marked")
    reach = range(-(spread // 2), spread - spread // 2)
    steps = F.array(*[F.struct(F.when(F.col("state") == 1, -r).when(F.col("state") == 0, 0).otherwise(r).alias("i"), F.lit(-r).alias("j")) for r in reach])
    channel = F.when(F.col("state") == 1, 1).when(F.col("state") == 0, 2).otherwise(3)
    sent = marked.select("sig", "t", "f", channel.alias("channel"), F.explode(steps).alias("o")).select("sig", (F.col("t") + F.col("o.i")).alias("t"), (F.col("f") + F.col("o.j")).alias("f"), "channel")
    lines = sent.join(marked.where("on").select("sig", "t", "f").hint("merge"), ["sig", "t", "f"], "left_semi").select("sig", "t", "f", "channel").distinct()
    own = marked.select("sig", "t", "f", F.explode(F.array_compact(F.array(F.when(F.col("on"), 0), F.when(F.col("late"), 4)))).alias("channel"))
    return lines.unionByName(own)


def support(response: np.ndarray, threshold: float) -> tuple[int, int]:
    """(start, length) of where a filter matters: the places above ``threshold`` times its top, on the circle of frequencies.

    The length is the whole's divided by a power of two, the least that holds them when the top stands in the middle.
    """
    size = np.abs(np.asarray(response))
    n, shift = len(size), len(size) // 2 - int(size.argmax()) - 1
    above = np.flatnonzero(np.roll(size, shift) > threshold * size.max())
    length = n // 2 ** int(np.log2(n / (above[-1] - above[0] + 1)))
    start = max((int(above[0]) + int(above[-1]) + 1) // 2 - length // 2, 0)
    return (min(start, n - length) - shift) % n, length


def stored_bank(bank: Sequence[np.ndarray], threshold: float) -> list[tuple[int, np.ndarray]]:
    """(start, values) of each filter by its support; places past the end go on at 0."""
    kept = []
    for row in bank:
        start, length = support(row, threshold)
        kept.append((start, np.take(row, np.arange(start, start + length), mode="wrap")))
    return kept


def log_smooth(spec: DataFrame, *, length: int = 7, halve: bool = False, across: bool = False) -> DataFrame:
    """(sig, t, f, v): logarithms, zeros taken as the signal's least other value, smoothed in time by a Gaussian of
    deviation 1 around length // 2, with zeros beyond the ends; every second frequency alone with ``halve``.

    ``across`` smooths over frequency first, where the whole kernel fits: length - 1 frequencies fewer come out,
    numbered from 0, and none of a spectrum that has fewer than ``length``.
    """
    g = np.exp(-((np.arange(length) - length // 2) ** 2) / 2)
    g = g / g.sum()
    least = F.min(F.when(F.col("v") != 0, F.col("v"))).over(Window.partitionBy("sig"))
    logs = spec.withColumn("v", F.ln(F.when(F.col("v") == 0, least).otherwise(F.col("v"))))
    if across:
        up = Window.partitionBy("sig", "t").orderBy("f")
        mixed = sum((F.lead("v", length - 1 - i).over(up) * float(x) for i, x in enumerate(g)), F.lit(0.0))
        logs = logs.select("sig", "t", "f", mixed.alias("v")).where(F.col("v").isNotNull())  # null where the kernel does not fit
    w = Window.partitionBy("sig", "f").orderBy("t")
    # zeros beyond the ends; in 'same' mode, output t takes input t + (length - 1) // 2 - i at kernel place i
    total = F.lit(0.0)
    for i, x in enumerate(g):
        total = total + F.coalesce(F.lag("v", i - (length - 1) // 2).over(w), F.lit(0.0)) * float(x)
    out = logs.select("sig", "t", "f", total.alias("v"))
    return out.where("f % 2 = 0") if halve else out

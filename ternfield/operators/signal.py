"""Signals, windows, peaks and intervals. A signal is (sig, n, x): samples by number from 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.functions.features import mirrored
from ternfield.operators.greedy import heads  # noqa: F401
from ternfield.operators.positions import running


def preemphasis(signal: DataFrame, *, coefficient: float = 0.95) -> DataFrame:
    before = F.lag("x").over(Window.partitionBy("sig").orderBy("n"))
    return signal.select("sig", "n", F.round(F.col("x") - coefficient * F.coalesce(before, F.lit(0.0)), 6).alias("y"))


def standardise(signal: DataFrame) -> DataFrame:
    return signal.select("sig", "n", F.round(F.try_divide(F.col("x"), F.stddev_pop("x").over(Window.partitionBy("sig"))), 6).alias("y"))


def frames(signal: DataFrame, *, nfft: int = 16, winsize: int = 16, oversampling: int = 1) -> DataFrame:
    """(sig, t, k, x): overlapping frames that start half a frame early; ends are mirrored.

    Each sample is sent to the frames that hold it; only the few mirrored places at the ends add to that. Samples are
    never broadcast, however small their files are.
    """
    hop = nfft >> oversampling
    sizes = signal.groupBy("sig").agg(F.count("*").alias("len")).where(F.col("len") > nfft)
    n_frames = F.floor(0.5 + F.col("len") / winsize * (1 << oversampling)).cast("int")
    places = sizes.where(n_frames > 0).select("sig", "len", F.explode(F.sequence(F.lit(0), n_frames - 1)).alias("t")).select("sig", "len", "t", F.explode(F.sequence(F.lit(0), F.lit(nfft - 1))).alias("k"))
    at = mirrored(F.col("t") * hop + F.col("k") - nfft // 2, F.col("len"))
    return places.select("sig", "t", "k", at.cast("long").alias("n")).join(signal.hint("merge"), ["sig", "n"]).select("sig", "t", "k", "x")


def spectrum(framed: DataFrame, *, nfft: int = 16) -> DataFrame:
    """(sig, t, f, v): magnitudes of the discrete Fourier transform of each frame, up to half the rate."""
    step = 2 * math.pi / nfft
    out = [F.struct(F.lit(f).alias("f"), F.sqrt(F.pow(F.sum(F.col("x") * F.cos(F.col("k") * (f * step))), 2) + F.pow(F.sum(F.col("x") * F.sin(F.col("k") * (f * step))), 2)).alias("v")) for f in range(nfft // 2 + 1)]
    return framed.groupBy("sig", "t").agg(F.array(*out).alias("o")).select("sig", "t", F.explode("o").alias("o")).select("sig", "t", "o.f", F.round("o.v", 5).alias("v"))


def peaks(signal: DataFrame, *, radius: int = 2, threshold: float = 0.0) -> DataFrame:
    top = F.max("x").over(Window.partitionBy("sig").orderBy("n").rowsBetween(-radius, radius))
    return signal.withColumn("top", top).where((F.col("x") >= F.col("top")) & (F.col("x") > threshold)).select("sig", "n", "x")


def smooth(signal: DataFrame, *, radius: int = 2) -> DataFrame:
    """Triangular smoothing; beyond the ends lies zero."""
    w = Window.partitionBy("sig").orderBy("n")
    total = sum((F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) + F.coalesce(F.lead("x", k).over(w), F.lit(0.0))) * (radius + 1 - k) for k in range(1, radius + 1)) + F.col("x") * (radius + 1)
    return signal.select("sig", "n", F.round(total / (radius + 1) ** 2, 6).alias("y"))


def cut(signal: DataFrame, centres: DataFrame, *, length: int) -> DataFrame:
    """(sig, c, k, x): windows of a length around centres (sig, c), mirrored at both ends."""
    sizes = signal.groupBy("sig").agg(F.count("*").alias("len")).where(F.col("len") > length)
    at = centres.join(sizes, "sig").select("sig", "c", "len", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    return at.select("sig", "c", "k", mirrored(F.col("c") + F.col("k") - length // 2, F.col("len")).cast("long").alias("n")).join(signal.hint("merge"), ["sig", "n"]).select("sig", "c", "k", "x")


def nearest_frame(points: DataFrame, *, hop: int) -> DataFrame:
    """points (…, s, e) with the frame whose midpoint hop * t is nearest to the middle of [s, e]; the first of two."""
    return points.withColumn("t", F.greatest(F.lit(0), F.ceil((F.col("s") + F.col("e")) / 2 / hop - 0.5)).cast("long"))


def assign(intervals: DataFrame, taken: DataFrame) -> DataFrame:
    """intervals with the head (start) that they overlap most, ties to the earlier one; those without overlap are left out.

    Both are dealt into bins as wide as the least power of two that is no less than their own length, so each lies in
    at most two. An interval looks for heads of its own or a lesser width in the bins of its width, and for wider ones
    in theirs, of which there are as many as heads have widths; so one very long interval costs no more than another.
    """
    def placed(df: DataFrame, *keep: str) -> DataFrame:
        wide = F.greatest(F.col("b") - F.col("a"), F.lit(1))
        level = F.ceil(F.log2(wide.cast("double"))).cast("int")
        return df.where("a <= b").select("sig", "a", "b", *keep, level.alias("level"))

    def bins(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        return F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))

    own = placed(intervals.select("sig", F.col("start").alias("a"), F.col("end").alias("b"), "score"), "score")
    h = placed(taken.select("sig", F.col("start").alias("a"), F.col("end").alias("b")))
    levels = F.broadcast(h.select(F.col("level").alias("at")).distinct().union(own.select("level").distinct()).distinct())  # 64 at most
    spread = lambda df, *keep: df.join(levels, F.col("at") >= F.col("level")).select("sig", "a", "b", *keep, "level", "at", F.explode(F.array_distinct(bins(F.col("at")))).alias("bin"))
    hs = spread(h).select("sig", F.col("a").alias("hs"), F.col("b").alias("he"), F.col("level").alias("h_level"), "at", "bin")
    # a pair meets at the greater of its two levels
    hit = spread(own, "score").join(hs, ["sig", "at", "bin"]).where("at = greatest(level, h_level)")
    hit = hit.withColumn("o", F.least("b", "he") - F.greatest("a", "hs")).where("o > 0")
    best = hit.groupBy("sig", F.col("a").alias("start"), F.col("b").alias("end"), "score").agg(F.min(F.struct((-F.col("o")).alias("o"), "hs"))["hs"].alias("head"))
    return best


def representatives(assigned: DataFrame) -> DataFrame:
    """(sig, head, start, end, score): each cluster's extent and best score."""
    return assigned.groupBy("sig", "head").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))


def roc(detections: DataFrame) -> DataFrame:
    """(score, hits, alarms): how many true and false detections have this score or more. Null scores are left out."""
    by = detections.where("score is not null").groupBy("score").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("alarms"))
    return running(by, "score", ["hits", "alarms"], descending=True).select("score", F.col("hits_upto").alias("hits"), F.col("alarms_upto").alias("alarms"))


def roc_rates(curve: DataFrame, *, hours: float) -> DataFrame:
    """(score, rate, alarms_per_hour): the share of all hits found, and false alarms by hour of signal."""
    every = curve.agg(F.max("hits").alias("every"))
    return curve.crossJoin(F.broadcast(every)).select("score", F.try_divide(F.col("hits").cast("double"), "every").alias("rate"), (F.col("alarms") / hours).alias("alarms_per_hour"))


def detector_peaks(scores: DataFrame, *, radius: int, threshold: float) -> DataFrame:
    """(sig, det, n, x): values above the threshold that no detector exceeds within ``radius`` places; all of equal ones stay."""
    near = F.explode(F.sequence(F.col("n") - radius, F.col("n") + radius)).alias("n")
    top = scores.groupBy("sig", "n").agg(F.max("x").alias("x")).select("sig", near, "x").groupBy("sig", "n").agg(F.max("x").alias("top"))
    return scores.where(F.col("x") > threshold).join(top, ["sig", "n"]).where("x >= top").select("sig", "det", "n", "x")


def centred_frame(points: DataFrame, *, length: int, hop: int) -> DataFrame:
    """points (…, s, e) with the frame of ``length`` samples whose centre is nearest to that of [s, e]."""
    return points.withColumn("t", F.round((F.col("s") + F.col("e") - length + 1) / (2.0 * hop)).cast("long"))


def filtered_fold(framed: DataFrame, response: Sequence[float], *, power: int) -> DataFrame:
    """(sig, t, q, re, im): frames (sig, t, k, x) filtered in the frequency domain and downsampled 2^power times.

    response: the filter at each frequency. Each 2^power neighbouring frequencies are summed, what remains is
    transformed back, and scaled by 2^-floor(power / 2). All of it is one linear map from the samples, as many
    literals as a frame has samples for each value.
    """
    n = len(response)
    m = n >> power
    f = np.arange(n)
    forward = np.asarray(response)[:, None] * np.exp(-2j * np.pi * f[:, None] * f / n)
    back = np.exp(2j * np.pi * np.arange(m)[:, None] * np.arange(m) / m) / m / 2 ** (power // 2)
    maps = back @ forward.reshape(m, n // m, n).sum(1)
    row = lambda w: F.sum(F.get(F.array(*[F.lit(float(x)) for x in w]), F.col("k")) * F.col("x"))
    out = [F.struct(F.lit(q).alias("q"), row(w.real).alias("re"), row(w.imag).alias("im")) for q, w in enumerate(maps)]
    return framed.groupBy("sig", "t").agg(F.array(*out).alias("o")).select("sig", "t", F.inline("o"))


def padded(signal: DataFrame, *, length: int) -> DataFrame:
    """The signal at the middle of ``length`` samples, mirrored about its ends on both sides; a signal that is longer stays."""
    sizes = signal.groupBy("sig").agg(F.count("*").alias("len"))
    room = F.greatest(F.lit(length) - F.col("len"), F.lit(0))
    left = F.floor(room / 2)
    places = sizes.select("sig", "len", left.alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") + room - 1)).alias("m"))
    turn = F.pmod(F.col("m") - F.col("left"), 2 * F.col("len"))
    return places.select("sig", "m", F.least(turn, 2 * F.col("len") - 1 - turn).alias("n")).join(signal.hint("merge"), ["sig", "n"]).select("sig", F.col("m").alias("n"), "x")


def unpadded(signal: DataFrame, sizes: DataFrame, *, length: int) -> DataFrame:
    """The samples of ``padded`` that were the signal's own; sizes: (sig, len)."""
    left = F.floor(F.greatest(F.lit(length) - F.col("len"), F.lit(0)) / 2)
    at = signal.join(sizes, "sig").withColumn("n", F.col("n") - left)
    return at.where((F.col("n") >= 0) & (F.col("n") < F.col("len"))).select("sig", "n", "x")


def segments(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """(sig, ord, k, …): the frames t with s <= t < e of every span (sig, ord, s, e), numbered from 0 by k.

    A span asks for its own frames by number, so long signals are not compared with every span.
    """
    wanted = spans.where("s < e").select("sig", "ord", "s", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("t"))
    return wanted.join(frames, ["sig", "t"]).withColumn("k", F.col("t") - F.col("s")).drop("s")


def padded_segments(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """``segments`` of frames whose head and tail are continued by themselves reversed; frames beyond that are left out."""
    sizes = frames.groupBy("sig").agg(F.count("*").alias("len"))
    wanted = spans.where("s < e").join(sizes, "sig").select("sig", "ord", "s", "len", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("at"))
    t = F.when(F.col("at") < 0, -1 - F.col("at")).when(F.col("at") >= F.col("len"), 2 * F.col("len") - 1 - F.col("at")).otherwise(F.col("at"))
    return wanted.select("sig", "ord", (F.col("at") - F.col("s")).alias("k"), t.alias("t")).join(frames, ["sig", "t"])

"""Tapers and spectra against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from ternfield.operators import signal, tapers

N = 16
H, DH, DDH, T = tapers.hermite(N - 1, 3)


def _signal(spark):
    x = np.round(np.random.default_rng(5).normal(size=90) + np.sin(np.arange(90) * 0.7), 6)
    return x, spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "sig int, n long, x double")


def _plain_frames(x):
    n = len(x)
    at = np.arange(N)[None, :] - N // 2 + N // 2 * np.arange(int(0.5 + n / N * 2))[:, None]
    at = np.abs(at)
    return x[np.where(at > n - 1, 2 * n - 2 - at, at)]


def _plain_quotients(x):
    framed = _plain_frames(x)[:, : N - 1]
    p_t = p_w = size = 0
    for h, d in zip(H, DH, strict=False):
        f, df, tf = (np.fft.fft(framed * w, N) for w in (h, d, T * h))
        p_t, p_w, size = p_t + (df / f).imag / 3, p_w - (tf / f).real / 3, size + np.abs(f) / 3
    return size, p_t, p_w


def test_tapers_are_orthonormal_and_derived():
    h, d, _, t = tapers.hermite(401, 4, 8.0)
    assert np.allclose(h @ h.T, np.eye(4), atol=1e-9)
    step = t[1] - t[0]
    assert np.allclose(d[:4, 1:-1] / step, np.gradient(h, step, axis=1)[:, 1:-1], atol=1e-3)
    assert tapers.hermite(16, 2)[0].shape == (2, 16) and not tapers.hermite(16, 2)[0][:, -1].any()
    assert tapers.mirrored_tail(np.array([[1, 2, 3]]), 2).tolist() == [[1, 2, 3, 3, 2]]


def test_filters():
    assert tapers.octaves(64) == 6
    assert abs(tapers.morlet(64, 1.5, 3.0)[0]) < 1e-12
    c, s = tapers.centres(2.0, 0.8, 0.8, 3, 1, 2)
    assert np.allclose(c[:3], [2, 1, 0.5]) and np.allclose(s, [0.8, 1.6, 3.2, 3.2, 3.2]) and (np.diff(c) < 0).all()
    psi, _ = tapers.filter_bank(64, c, s, 3, 3.2)
    assert np.isclose((psi[:3] ** 2).sum(0).max(), 2)


def test_phase_bits_equal_plain(spark):
    x, df = _signal(spark)
    size, p_t, p_w = _plain_quotients(x)
    got = tapers.derivatives(signal.frames(df), H, DH, T, nfft=N, bins=N)
    rows = got.collect()
    assert len(rows) == size.size
    for r in rows:
        i = r["t"], r["f"]
        assert np.allclose([r["v"], r["p_t"], r["p_w"]], [size[i], p_t[i], p_w[i]], atol=1e-8)
    i, j = np.mgrid[:8, :8]
    kernel = np.exp(-((i - 4) ** 2 + (j - 4) ** 2) / 4.0)
    by_w, by_t = -(j - 3.5) / 2 * kernel, -(i - 3.5) / 2 * kernel

    def conv(a, k):
        # edges mirrored about the border; an even kernel's centre is its place size // 2
        wide = np.pad(a, 8, mode="symmetric")
        return np.array([[sum(k[u, v] * wide[8 + t + 4 - u, 8 + f + 4 - v] for u in range(8) for v in range(8)) for f in range(a.shape[1])] for t in range(a.shape[0])])

    wt, tt, tw = conv(p_t, by_w), conv(p_t, by_t), conv(p_w, by_t)
    state = np.where(np.abs(tt) > 0.05, np.sign(tt), 0)
    want = set()
    for t in range(wt.shape[0]):
        for f in range(wt.shape[1]):
            near = lambda value, slope: any(0 <= t + slope * r < wt.shape[0] and 0 <= f + r < wt.shape[1] and state[t + slope * r, f + r] == value for r in (-1, 0, 1))  # noqa: B023, E731
            on = wt[t, f] > 0.12
            want |= {(t, f, c) for c, ok in enumerate([on, on and near(1, 1), on and near(0, 0), on and near(-1, -1), tw[t, f] > 4.125]) if ok}
    bits = tapers.phase_bits(got, bins=N, kernel=kernel, sigma=2.0)
    assert {(r["t"], r["f"], r["channel"]) for r in bits.collect()} == want


def test_log_smooth_equals_plain(spark):
    v = np.random.default_rng(6).uniform(0.1, 2, (20, 4))
    v[3, 2] = 0
    df = spark.createDataFrame([(1, t, f, float(v[t, f])) for t in range(20) for f in range(4)], "sig int, t int, f int, v double")
    logs = np.log(np.where(v == 0, v[v != 0].min(), v))
    for length in (7, 8):
        g = np.exp(-((np.arange(length) - length // 2) ** 2) / 2)
        want = np.array([np.convolve(logs[:, f], g / g.sum(), "full")[(length - 1) // 2 :][:20] for f in range(4)]).T
        for r in tapers.log_smooth(df, length=length).collect():
            assert np.isclose(r["v"], want[r["t"], r["f"]])
    assert tapers.log_smooth(df, halve=True).select("f").distinct().orderBy("f").collect() == [(0,), (2,)]
    assert tapers.log_smooth(df.where(F.lit(False))).count() == 0


def test_supports_hold_what_is_above_the_threshold():
    rng = np.random.default_rng(2)
    for n in (16, 64):
        for centre in range(n):
            far = np.minimum(np.abs(np.arange(n) - centre), n - np.abs(np.arange(n) - centre))
            row = np.exp(-(far**2) / rng.uniform(0.5, n / 4)) * (1 + 0.01 * rng.random(n))
            (start, kept), = tapers.stored_bank([row], 0.1)
            assert n % len(kept) == 0
            back = np.zeros(n)
            back[(start + np.arange(len(kept))) % n] = kept
            above = row > 0.1 * row.max()
            # a support may lose a place at an end where it is not symmetric about its middle
            assert (back[above] == row[above]).sum() >= above.sum() - 1 and set(back[back != 0]) <= set(row)


def test_log_smoothing_over_frequency(spark):
    rng = np.random.default_rng(7)
    x = rng.random((5, 9))
    x[2, 3] = 0
    spec = spark.createDataFrame([("a", t, f, float(x[t, f])) for t in range(5) for f in range(9)] + [("short", 0, f, 1.0) for f in range(3)], "sig string, t int, f int, v double")
    got = {(r["sig"], r["t"], r["f"]): r["v"] for r in tapers.log_smooth(spec, length=7, across=True).collect()}
    g = np.exp(-((np.arange(7) - 3) ** 2) / 2)
    g /= g.sum()
    logs = np.log(np.where(x == 0, x[x > 0].min(), x))
    valid = np.array([np.convolve(row, g, mode="valid") for row in logs])
    want = np.array([[sum(g[i] * valid[t - i + 3, f] for i in range(7) if 0 <= t - i + 3 < 5) for f in range(3)] for t in range(5)])
    assert set(got) == {("a", t, f) for t in range(5) for f in range(3)}
    assert all(abs(got["a", t, f] - want[t, f]) < 1e-9 for t in range(5) for f in range(3))


def test_phase_bits_have_a_small_plan(spark):
    """The plan holds neither the spectra's literals nor copies of them: it reads what was written once."""
    _, df = _signal(spark)
    i, j = np.mgrid[:8, :8]
    bits = tapers.phase_bits(tapers.derivatives(signal.frames(df), H, DH, T, nfft=N, bins=N), bins=N, kernel=np.exp(-((i - 4) ** 2 + (j - 4) ** 2) / 4.0), sigma=2.0)
    assert len(bits._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    for df in (bits, signal.frames(df)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_convolve_takes_absent_and_null_cells_as_zero(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(5, 4)), rng.normal(size=(4, 4))
    cells = [("a", t, f, None if (t, f) == (1, 1) else float(x[t, f])) for t in range(5) for f in range(4) if (t, f) != (2, 3)]
    got = tapers.convolve(spark.createDataFrame([*cells, ("short", 0, 0, 2.0)], "sig string, t int, f int, v double"), {"y": ("v", k)}, bins=4)
    x[1, 1] = x[2, 3] = 0
    wide = np.pad(x, 4, mode="symmetric")
    y = {(r["sig"], r["t"], r["f"]): r["y"] for r in got.collect()}
    assert set(y) == {(s, t, f) for s, t, f, _ in cells} | {("short", 0, 0)}
    assert all(np.isclose(y["a", t, f], sum(k[u, v] * wide[4 + t + 2 - u, 4 + f + 2 - v] for u in range(4) for v in range(4))) for _, t, f, _ in cells)
    assert np.isclose(y["short", 0, 0], 2 * sum(k[:, j].sum() for j in range(4) if (2 - j) % 8 in (0, 7)))

"""Readers on small files, and padding."""

import wave

import numpy as np
from pyspark.sql import functions as F

from ternfield.operators import detect, learn, signal
from ternfield.sources import tables


def test_sounds(spark, tmp_path):
    x = np.arange(-5, 5, dtype="<i2")
    (tmp_path / "a").mkdir()
    with wave.open(str(tmp_path / "a" / "sx1.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(x.tobytes())
    (tmp_path / "si2.wav").write_bytes(b"no sound")
    (tmp_path / "sa3.wav").write_bytes(b"")
    got = {r["path"].rsplit("/")[-1]: r for r in tables.sounds(spark, str(tmp_path), pattern="s[ix]*.wav").collect()}
    assert set(got) == {"sx1.wav", "si2.wav"}
    assert got["sx1.wav"]["x"] == x.tolist() and got["sx1.wav"]["rate"] == 16000 and got["si2.wav"]["x"] is None
    assert tables.samples(tables.sounds(spark, str(tmp_path))).where("n = 0").first()["x"] == -5 / 32768


def test_arrays_text_and_settings(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert [r["v"] for r in tables.arrays(spark, str(tmp_path)).orderBy("row").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    np.save(tmp_path / "one.npy", np.float64(3))
    (tmp_path / "no.npy").write_bytes(b"no array")
    (tmp_path / "cut.npy").write_bytes((tmp_path / "m.npy").read_bytes()[:-8])
    (tmp_path / "empty.npy").write_bytes(b"")
    read = tables.arrays(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/")[-1] for r in read.where("row is null and v is null").collect()) == ["cut.npy", "no.npy", "one.npy"]
    assert read.where("row is not null").count() == 2
    (tmp_path / "m.map").write_text("aa vowel\n\n  s   fricative\n")
    assert sorted(map(tuple, tables.label_map(spark, str(tmp_path / "m.map")).collect())) == [("aa", "vowel"), ("s", "fricative")]
    (tmp_path / "m.txt").write_text("1 2.5\n\n# note\n 3   4 # end\n")
    assert sorted(r["v"] for r in tables.text_matrix(spark, str(tmp_path / "m.txt")).collect()) == [[1.0, 2.5], [3.0, 4.0]]
    assert tables.settings("[A]\nx = 3\nY = (1, 2)\nz = word\n") == {"A": {"x": 3, "Y": (1, 2), "z": "word"}}


def test_padding_and_segments(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], "sig int, n long, x double")
    wide = signal.padded(df, length=8)
    assert [r["x"] for r in wide.orderBy("n").collect()] == [2, 1, 1, 2, 3, 3, 2, 1]
    sizes = spark.createDataFrame([(1, 3)], "sig int, len long")
    assert signal.unpadded(wide, sizes, length=8).orderBy("n").collect() == df.orderBy("n").collect()
    spans = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 2)], "sig int, ord int, s long, e long")
    got = signal.segments(df.withColumnRenamed("n", "t"), spans).orderBy("k").collect()
    assert [(r["ord"], r["k"], r["x"]) for r in got] == [(0, 0, 2.0), (0, 1, 3.0)]


def test_cascade_and_matches(spark):
    ranked = spark.createDataFrame([(1, 7, c, 0.0, c) for c in range(1, 6)] + [(2, 7, 1, 0.0, 1)], "ex int, truth int, cls int, score double, rank int")
    second = spark.createDataFrame([(1, c, s) for c, s in enumerate([0.4, -0.1, 0.2, -3.0, 0.1], 1)] + [(2, 1, 0.5)], "ex int, cls int, second double")
    assert {r["ex"]: r["guess"] for r in detect.cascade(ranked, second).collect()} == {1: 2, 2: None}
    det = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.2), (1, 2, 9.0)], "sig int, det int, mid double")
    true = spark.createDataFrame([(1, 0, 1.1), (1, 1, 5.0), (2, 0, 1.0)], "sig int, truth int, tmid double")
    got = {tuple(r) for r in detect.outcomes(det, true, tolerance=0.5).select("sig", "hits", "alarms", "misses").collect()}
    assert got == {(1, 1, 2, 1), (2, 0, 0, 1)}
    assert detect.outcomes(det.limit(0), true.limit(0), tolerance=0.5).count() == 0


def test_losses_equal_plain(spark):
    rng = np.random.default_rng(3)
    x, y, w = (rng.random((60, 8)) < 0.5).astype(float), rng.integers(0, 3, 60), rng.normal(size=(6, 8)).round(3)
    classes = [0, 1, 2, 0, 1, 2]
    df = spark.createDataFrame([(int(c), [int(i) for i in np.flatnonzero(r)]) for c, r in zip(y, x, strict=True)], "cls int, idx array<int>")
    z = x @ w.T
    for loss in ("hinge", "ramp", "self_paced", "smoothed"):
        want = np.zeros_like(w)
        for row, c, s in zip(x, y, z, strict=True):
            mine, rest = [j for j in range(6) if classes[j] == c], [j for j in range(6) if classes[j] != c]
            own, off = max(s[mine]), max(s[rest])
            gap = off - own
            if gap <= -1 or (loss == "ramp" and gap >= 1) or (loss == "self_paced" and 0.7 * (1 + gap) >= 1):
                continue
            pull = np.zeros(6)
            for group, best, sign in ((mine, own, 1), (rest, off, -1)):
                share = np.exp((s[group] - best) / 0.5) if loss == "smoothed" else (np.arange(len(group)) == int(np.argmax(s[group]))).astype(float)
                pull[group] = sign * share / share.sum()
            want += pull[:, None] * row
        got = learn.gradient(learn.pulls(learn.margins(df, w), classes, loss=loss, k=0.7, gamma=0.5, beta=0.5), 6, 8)
        assert np.allclose(got, want, atol=1e-8), loss
    far = sum(((w[i] - w[j]) ** 2).sum() for i in range(6) for j in range(i))
    assert np.isclose(learn.pair_distance(w), far) and np.isclose(np.linalg.norm(learn.projected(w * 9, 0.25)), 2)
    assert (learn.multiclass(df.limit(0), 8, classes, steps=2, rate=1.0, start=w) == w).all()


def test_em_prunes_to_one(spark):
    from ternfield.operators import iterate

    df = spark.createDataFrame([(i, [i % 2]) for i in range(12)], "ex long, idx array<int>")
    soft, k = iterate.pruned(df, 2, 3, least=100.0, rounds=1)
    assert k == 1 and soft.agg(F.sum(F.get("a", 0))).first()[0] == 12
    best = iterate.restarts(df, 2, 2, seeds=[1, 2], rounds=3)
    assert best[1] in (1, 2) and best[2] > -12


def test_forms_read_examples_without_a_join(spark):
    from ternfield.plans import learning

    both, fits = learning._form_fits(spark, "/root/testdata/sf0.001")
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString() and len(fits) == len(learning.FORMS)

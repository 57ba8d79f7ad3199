"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternfield.functions.features import mirrored, path_id, set_bits, with_bias
from ternfield.operators import classify, iterate, models, nearest, positions, signal
from ternfield.sources.tables import instances


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def test_bits_and_bias(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 1.0]), (2, [0.0, 0.0, 0.0])], "ex long, v array<double>")
    got = df.orderBy("ex").select(with_bias(set_bits(F.col("v")), 3).alias("i")).collect()
    assert [r["i"] for r in got] == [[1, 3], [0, 2, 3], [3]]


def test_mirrored(spark):
    df = spark.createDataFrame([(i,) for i in (-2, 0, 4, 5, 6)], "i int")
    assert [r[0] for r in df.select(mirrored(F.col("i"), F.lit(5))).collect()] == [2, 0, 4, 3, 2]


def test_preemphasis(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0)], "sig int, n long, x double")
    assert [r["y"] for r in signal.preemphasis(df).orderBy("n").collect()] == [1.0, 1.05, 2.1]


def test_instances_and_path(spark):
    df = spark.createDataFrame([("a/b/c.wav 1 5 | 7 9",), ("x 2 3",), ("y",)], "value string")
    assert rows(instances(df), "path", "ord") == [("a/b/c.wav", 0, 1, 5), ("a/b/c.wav", 1, 7, 9), ("x", 0, 2, 3)]
    assert spark.range(1).select(path_id(F.lit("r/dr1/spk/sx1.wav"), "\\.wav")).first()[0] == "dr1_spk_sx1"


def test_confusion_and_reduction(spark):
    p = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1)], "guess int, truth int")
    dense = classify.dense_confusion(classify.confusion(p))
    assert rows(dense.select("label", "guess", "n"), "label", "guess") == [(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 1)]
    m = spark.createDataFrame([(0, 0), (1, 0)], "fine int, coarse int")
    c = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 1, 3)], "label int, guess int, n long")
    assert rows(classify.reduce_confusion(c, m), "coarse_label") == [(0, 0, 6)]


def test_vote_ties(spark):
    s = spark.createDataFrame([(1, 0, c, 0.0) for c in range(3)], "ex long, truth int, cls int, score double")
    assert classify.pair_votes(s).first()["guess"] == 0
    assert classify.pair_votes(s, high_ties=True).first()["guess"] == 2


def test_heads(spark):
    i = spark.createDataFrame([(1, a, b, 1.0) for a, b in ((1, 4), (3, 5), (6, 9), (8, 10), (11, 12))], "sig int, start long, end long, score double")
    assert rows(signal.heads(i), "start") == [(1, 1, 4), (1, 6, 9), (1, 11, 12)]
    assert rows(signal.assign(i, signal.heads(i)).select("start", "head"), "start") == [(1, 1), (3, 1), (6, 6), (8, 6), (11, 11)]


def test_upper_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert classify.upper_median(df, "x").first()["median"] == 3.0


def test_em_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    df = spark.createDataFrame([(i, [int(d) for d in np.flatnonzero(r)]) for i, r in enumerate(x)], "ex long, idx array<int>")
    a = np.eye(2)[np.arange(40) % 2]
    for _ in range(3):
        w = a.sum(0) / a.sum()
        p = np.clip(a.T @ x / a.sum(0)[:, None], 0.01, 0.99)
        z = np.log(w) + x @ np.log(p).T + (1 - x) @ np.log(1 - p).T
        a = np.exp(z - z.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
    soft, history = iterate.em(df, 6, 2, rounds=3, tol=1e-12)
    got = np.array([r["a"] for r in soft.orderBy("ex").collect()])
    assert np.abs(got - a).max() < 1e-9
    assert all(y >= x - 1e-6 for x, y in zip(history, history[1:]))


def test_running_and_zipped(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(500)
    df = spark.createDataFrame([(int(k), int(k) % 7) for k in keys] + [(None, 5)], "k long, v long")
    got = {r["k"]: r["v_upto"] for r in positions.running(df, "k", ["v"], blocks=9).collect()}
    total = np.cumsum([5] + [k % 7 for k in range(500)])
    assert got == {None: 5} | {k: total[k + 1] for k in range(500)}
    down = {r["k"]: r["v_upto"] for r in positions.running(df, "k", ["v"], blocks=9, descending=True).collect()}
    assert down[499] == 499 % 7 and down[0] == sum(k % 7 for k in range(500)) and down[None] == down[0] + 5
    names = spark.createDataFrame([(f"w{k:03}",) for k in keys], "word string")
    assert {r["word"]: r["id"] for r in positions.numbered(names, "word", name="id").collect()} == {f"w{k:03}": k for k in range(500)}
    both = positions.zipped(names.limit(30), "word", df.where("k is not null"), "k")
    assert [r["k"] for r in both.orderBy("word").collect()] == list(range(30))
    assert positions.numbered(names.limit(0), "word").count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    bits = rng.random((300, 130)) < 0.5
    bits[50:60] = bits[40]  # ties
    df = spark.createDataFrame([(i, [int(d) for d in np.flatnonzero(b)]) for i, b in enumerate(bits)], "id long, idx array<int>").repartition(4)
    rows = df.select("id", nearest.packed(F.col("idx"), 130).alias("words"))
    dist = (bits[:, None] != bits[None]).sum(2)
    for block in (100, 7):
        got = {(r["q"], r["r"]): (r["t"], r["dist"]) for r in nearest.nearest(rows, rows.where("id % 20 = 0"), k=5, block=block).collect()}
        want = {(q, r + 1): (t, dist[q, t]) for q in range(0, 300, 20) for r, t in enumerate(sorted((t for t in range(300) if t != q), key=lambda t: (dist[q, t], t))[:5])}
        assert got == want
    assert nearest.nearest(rows, rows.limit(0), k=5).count() == nearest.nearest(rows.limit(0), rows, k=5).count() == 0


def test_local_scale_gives_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = rng.integers(-(2**62), 2**62, (60, 2))
    rows = spark.createDataFrame([(i, [int(x) for x in w]) for i, w in enumerate(words)], "id long, words array<long>")
    dist = np.bitwise_count(words[:, None].view(np.uint64) ^ words[None].view(np.uint64)).sum(2).astype(int)
    s = np.sort(dist + 1000 * np.eye(60, dtype=int), axis=1)[:, 6]
    want = sorted((q, t, int(dist[q, t] * s[q] * s[t])) for q in range(0, 60, 2) for t in range(0, 60, 2) if q != t)
    for side in (7, 1024):
        got = nearest.local_scale(rows, rows.where("id % 2 = 0"), side=side)
        assert sorted(tuple(r) for r in got.select("q", "t", "k").collect()) == want
    assert nearest.local_scale(rows, rows.limit(0)).count() == 0


def test_nearest_by_bands(spark):
    rng = np.random.default_rng(3)
    centres = rng.random((40, 128)) < 0.5
    bits = centres[rng.integers(0, 40, 400)] ^ (rng.random((400, 128)) < 0.02)  # near rows, which the index settles
    bits[:60] = rng.random((60, 128)) < 0.5  # far ones, which it does not
    bits[100:220] = bits[100]  # a bucket with over a quarter of all rows
    df = spark.createDataFrame([(i, [int(d) for d in np.flatnonzero(b)]) for i, b in enumerate(bits)] + [(None, [1])], "id long, idx array<int>").repartition(4)
    rows = df.select("id", nearest.packed(F.col("idx"), 128).alias("words"))
    queries = rows.where("id % 10 = 0")
    dist = (bits[:, None] != bits[None]).sum(2)
    want = {(q, r + 1): (t, dist[q, t]) for q in range(0, 400, 10) for r, t in enumerate(sorted((t for t in range(400) if t != q), key=lambda t: (dist[q, t], t))[:4])}
    got = [((r["q"], r["r"]), (r["t"], r["dist"])) for r in nearest.nearest_by_bands(rows, queries, k=4, dim=128, bands=8, share=0.5).collect()]
    assert len(got) == len(want) and dict(got) == want
    met, left = nearest.candidates(rows, queries, dim=128, bands=8, reach=1, share=0.5)
    pairs = [(r["q"], r["t"], r["dist"]) for r in met.collect()]
    left = {r["q"] for r in left.collect()}
    assert len(pairs) == len({p[:2] for p in pairs}) and all(dist[q, t] == d for q, t, d in pairs)
    assert set(range(100, 220, 10)) <= left and not left & {q for q, _, _ in pairs}
    assert {(q, t) for q in range(0, 400, 10) for t in range(400) if q not in left and q != t and dist[q, t] < 16} <= {p[:2] for p in pairs}
    assert 0 < len(pairs) < 40 * 400 * 0.1  # a small part of what the blocks compare
    settled = {q for q in range(60, 400, 10) if q not in left and sum(d < 16 for a, _, d in pairs if a == q) >= 4}
    assert len(settled) > 15
    assert nearest.nearest_by_bands(rows, rows.limit(0), k=4, dim=128, bands=8).count() == nearest.nearest_by_bands(rows.limit(0), queries, k=4, dim=128, bands=8).count() == 0
    with pytest.raises(ValueError):
        nearest.banded(rows, 130, 8)


def test_heads_against_plain_code(spark):
    rng = np.random.default_rng(3)
    spans = [(int(s), int(a), int(a + n), float(x)) for s, a, n, x in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400), rng.integers(1, 25, 400), rng.random(400))]
    i = spark.createDataFrame(spans, "sig int, start long, end long, score double")
    want = []
    for sig in range(3):
        last = None
        for e, s in sorted((e, s) for g, s, e, _ in spans if g == sig):
            if last is None or s >= last:
                want.append((sig, s, e))
                last = e
    got = signal.heads(i)
    assert rows(got, "sig", "start") == sorted(want)
    head = {}
    for g, s, e, x in spans:
        over = [(-(min(e, he) - max(s, hs)), hs) for hg, hs, he in want if hg == g and min(e, he) > max(s, hs)]
        if over:
            head[g, s, e, x] = min(over)[1]
    assert {tuple(r)[:4]: r["head"] for r in signal.assign(i, got).collect()} == head


def test_p_values_against_erfc(spark):
    from math import erfc, sqrt

    z = [0.0, 0.1, -1.0, 1.96, 3.0, -6.0, 12.0, 30.0]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in z], "z double").select(models.two_sided_p(F.col("z")).alias("p")).collect()]
    assert all(abs(p - erfc(abs(x) / sqrt(2))) <= 3e-7 * erfc(abs(x) / sqrt(2)) for p, x in zip(got, z))


def test_language_tests_read_texts_once(spark, tmp_path):
    """The registered query's plan, however often its tests are used, does not scan documents again."""
    from ternfield.plans import catalog, models as plans  # noqa: F401

    docs = [(i, "de" if i % 2 else "en", t) for i, t in enumerate(["the,the", "und", "THE end", None, " of  the", "die und", "the", "the\nend"] * 30)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tests = catalog.QUERIES["p_values"](spark, str(tmp_path))
    assert "documents.parquet" not in tests._jdf.queryExecution().executedPlan().toString() and tests.count() == 12
    p = {r["d"]: r["p"] for r in tests.collect()}
    # shares of en and de: "the" 3/4 and 0, "und" 0 and 1/2 by words between single spaces
    z = {0: (0.75 - 0.01) / (0.38 * 0.62 / 60) ** 0.5, 6: (0.01 - 0.5) / (0.255 * 0.745 / 60) ** 0.5}
    got = spark.createDataFrame(sorted(z.items()), "d int, z double").select("d", models.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(p[r["d"]] - r["p"]) < 1e-9 for r in got)


def test_step_up(spark):
    p = spark.createDataFrame([(x,) for x in (0.001, 0.008, 0.039, 0.041, 0.042, 0.06, None)], "p double")
    kept = [r["p"] for r in models.step_up(p, "p", alpha=0.05, total=F.lit(6)).orderBy("p").collect()]
    assert kept == [0.001, 0.008]
    assert models.step_up(p.limit(0), "p", alpha=0.05, total=F.lit(6)).count() == 0


def test_smoothed_assignments(spark):
    scores = [(1, 0, 0, 0, 2.0), (1, 0, 0, 1, 1.0), (1, 0, 1, 0, 1.5), (1, 0, 1, 1, -90.0), (2, 0, 0, 0, 90.0), (2, 0, 1, 0, 0.0)]
    df = spark.createDataFrame(scores, "ex long, truth int, cls int, comp int, score double")
    got = {(r["ex"], r["cls"], r["comp"]): r["a"] for r in models.smoothed_assignments(df, beta=2.0, gamma=3.0).collect()}
    e = np.exp
    extra = e(-(1 + 1.5 - 2.0) / 3)
    want = {(1, 0, 0): 1 / (1 + e(-0.5)), (1, 0, 1): e(-0.5) / (1 + e(-0.5)), (1, 1, 0): 1 / (1 + extra)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_reordered_graph():
    edges = [(0, 5), (5, 2), (2, 7), (7, 1), (3, 4)]
    order = models.reordered(edges, range(8))
    assert sorted(order) == list(range(8))
    place = {n: i for i, n in enumerate(order)}
    assert max(abs(place[a] - place[b]) for a, b in edges) == 1


def test_pair_guesses(spark):
    rng = np.random.default_rng(5)
    classes, dim = [2, 3, 7, 11], 6
    w = {(i, j): rng.integers(-1, 2, dim).astype(float) for i in classes for j in classes if i < j}
    bias = {p: float(rng.integers(-1, 2)) for p in w}
    idx = {e: sorted(rng.choice(9, rng.integers(0, 5), replace=False).tolist()) for e in range(60)} | {60: None}  # ids from dim on have no weight
    weights = spark.createDataFrame([(i, j, d, x) for (i, j), v in w.items() for d, x in enumerate(v.tolist())], "i int, j int, d int, w double")
    row = models.pair_row(weights, spark.createDataFrame([(*p, b) for p, b in bias.items()], "i int, j int, b double"))
    ex = spark.createDataFrame([(e, 3, i) for e, i in idx.items()], "ex long, cls int, idx array<int>")
    votes = {}
    for e, at in idx.items():
        v = votes[e] = dict.fromkeys(classes, 0)
        for (i, j), x in w.items():
            s = bias[i, j] + sum(x[d] for d in at or [] if d < dim)
            v[i] += s > 0
            v[j] += s < 0
    for high in (False, True):
        got = {r["ex"]: r["guess"] for r in models.pair_guesses(ex, row, high_ties=high).collect()}
        assert got == {e: max(classes, key=lambda c: (v[c], c if high else -c)) for e, v in votes.items()}
    assert models.pair_guesses(ex.limit(0), row).count() == models.pair_guesses(ex, models.pair_row(weights.limit(0), weights.select("i", "j", "w").limit(0).withColumnRenamed("w", "b"))).count() == 0


def test_pair_errors_and_inner_cells(spark):
    from ternfield.operators import models, patches

    weights = spark.createDataFrame([(0, 1, 0, 1.0), (0, 1, 1, -1.0), (0, 2, 0, 2.0)], "i int, j int, d int, w double")
    row = models.pair_row(weights, spark.createDataFrame([(0, 1, 0.0), (0, 2, -1.0)], "i int, j int, b double"))
    examples = spark.createDataFrame([(1, 0, [0]), (2, 0, [1]), (3, 1, [0]), (4, 2, []), (5, 2, None), (6, 7, [0])], "ex long, cls int, idx array<int>")
    got = {(r["label"], r["other"]): r["n"] for r in models.pair_errors(examples, row).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (1, 0): 1, (2, 0): 0}
    places = [(1, 0, 0, c * 2 + c % 2) for c in range(9)] + [(2, 0, 0, c * 2) for c in range(8)] + [(2, 0, 0, 1)]
    placed = spark.createDataFrame(places, "ex int, t int, f int, d int")
    assert {r["ex"] for r in patches.inner_full(placed, size=3, radius=1, channels=2).collect()} == {1}
    assert {r["ex"] for r in patches.inner_full(placed, size=3, radius=0, channels=2).collect()} == {1, 2}


def test_pair_matrix_is_dense_and_ordered(spark):
    from ternfield.operators import models

    weights = spark.createDataFrame([(0, 1, 1, 2.0), (1, 2, 0, 3.0)], "i int, j int, d int, w double")
    bias = spark.createDataFrame([(1, 2, 0.5), (0, 2, 0.1), (0, 1, -1.0)], "i int, j int, b double")
    got = [tuple(r) for r in models.pair_matrix(weights, bias, 2).orderBy("row").collect()]
    assert got == [(0, 1, 0, -1.0, [0.0, 2.0]), (1, 2, 0, 0.1, [0.0, 0.0]), (2, 2, 1, 0.5, [3.0, 0.0])]
    assert models.pair_matrix(weights.limit(0), bias.limit(0), 2).count() == 0

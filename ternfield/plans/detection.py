"""Queries over ``operators.detect``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ternfield.operators import classify, detect, models, patches
from ternfield.plans.catalog import BITS, CELL, DIM, PATCH, PRED, SC, SIDE, TMPL, cells, examples, model, placed, query, scored
from ternfield.sources.tables import table

POOL = PRED + """,
pool AS (SELECT d, greatest(least(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 99e-2), 1e-2) AS p FROM ones GROUP BY 1),
pdot AS (SELECT o.ex, sum(ln(p) - ln(1 - p)) AS s FROM ones o JOIN pool USING (d) GROUP BY 1),
psc AS (SELECT e.vec_id AS ex, round((SELECT sum(ln(1 - p)) FROM pool) + coalesce(s, 0), 9) AS pooled FROM embeddings e LEFT JOIN pdot ON pdot.ex = e.vec_id),
sec AS (SELECT ex, cls, round(pooled - score, 6) AS second FROM sc JOIN psc USING (ex))"""


def second_scores(spark, sf):
    """Each class's template against the template of all examples, below 0 where the class fits better."""
    pooled = classify.scores(examples(spark, sf), classify.templates(examples(spark, sf).withColumn("cls", F.lit(0)), DIM)).select("ex", F.col("score").alias("pooled"))
    return scored(spark, sf).join(pooled, "ex").select("ex", "cls", F.round(F.col("pooled") - F.col("score"), 6).alias("second"))


@query(f"WITH {POOL} SELECT rk.ex, rk.truth, arg_min(rk.cls, rk.rank) FILTER (WHERE second <= 0) AS guess FROM rk JOIN sec USING (ex, cls) WHERE rk.rank <= 5 GROUP BY 1, 2")
def cascade(spark, sf):
    return detect.cascade(classify.ranked(scored(spark, sf)), second_scores(spark, sf))


HARD = PRED + ", own AS (SELECT ex, rank AS own FROM rk WHERE cls = truth)"


@query(f"WITH {HARD} SELECT cls, ex, cls = truth AS positive FROM rk JOIN own USING (ex) WHERE CASE WHEN cls = truth THEN rank <= 5 ELSE rank > own END")
def hard_examples_by_rank(spark, sf):
    return detect.hard_examples(classify.ranked(scored(spark, sf)), positive_top=5)


@query(f"WITH {HARD}, m AS (SELECT cls, cls = truth AS positive FROM rk WHERE CASE WHEN cls = truth THEN rank <= 10 ELSE rank <= 6 END) SELECT cls, count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE NOT positive) AS negatives FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE positive) >= 20 AND count(*) FILTER (WHERE NOT positive) >= 20")
def hard_examples_by_top(spark, sf):
    return detect.trainable(detect.hard_examples(classify.ranked(scored(spark, sf)), positive_top=10, negative_top=6))


@query(f"WITH {PRED}, t AS (SELECT * FROM rk WHERE rank <= 5), v AS (SELECT a.ex, a.truth, a.cls, count(b.cls) AS v FROM t a LEFT JOIN t b ON b.ex = a.ex AND a.score > b.score GROUP BY 1, 2, 3) SELECT ex, truth, arg_min(cls, v * -1000 + cls) AS guess FROM v GROUP BY 1, 2")
def top_votes(spark, sf):
    return detect.top_votes(classify.ranked(scored(spark, sf)))


OFF = SC + ", off AS (SELECT cls, avg(score) AS mu, stddev_samp(score) AS sd FROM sc WHERE cls <> truth GROUP BY 1)"


@query(f"WITH {OFF} SELECT cls, round(mu, 6) AS mu, round(sd, 6) AS sd FROM off")
def off_class_stats(spark, sf):
    return detect.off_class(scored(spark, sf)).select("cls", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))


@query(f"WITH {OFF} SELECT ex, truth, cls, round((score - mu) / sd, 6) AS score FROM sc JOIN off USING (cls)")
def normalised_scores(spark, sf):
    return detect.normalised(scored(spark, sf))


PW = TMPL + ", pw AS (SELECT a.cls AS i, b.cls AS j, a.d, a.w - b.w AS w FROM lo a JOIN lo b ON a.d = b.d AND a.cls < b.cls)"


@query(f"WITH {PW}, q AS (SELECT i, j, quantile_cont(abs(w), 75e-2) AS cut FROM pw GROUP BY 1, 2) SELECT i, j, d, round(CASE WHEN abs(w) >= cut - 1e-12 THEN w ELSE 0 END, 9) + 0e0 AS w FROM pw JOIN q USING (i, j)")
def pair_sparsified(spark, sf):
    weights = classify.pair_weights(model(spark, sf))
    return detect.sparsify(weights, 0.75).withColumn("w", F.round("w", 9) + 0.0)


@query("SELECT count(DISTINCT label) AS classes, 5e-2 / (count(DISTINCT label) * (count(DISTINCT label) - 1) / 2 * 64) AS level FROM embeddings")
def bonferroni_level(spark, sf):
    n = F.col("classes")
    return table(spark, sf, "embeddings").agg(F.countDistinct("label").alias("classes")).select("classes", (0.05 / (n * (n - 1) / 2 * DIM)).alias("level"))


KNOWN = SC + """, own AS (SELECT ex, score AS own FROM sc WHERE cls = truth),
kp AS (SELECT truth AS label, cls AS other, sum((score > own)::INT)::BIGINT AS n FROM sc JOIN own USING (ex) WHERE cls <> truth GROUP BY 1, 2)"""


@query(f"WITH {KNOWN} SELECT a.label, a.other, a.n - b.n AS diff FROM kp a JOIN kp b ON a.label = b.other AND a.other = b.label")
def pair_differences(spark, sf):
    kp = classify.known_pairs(scored(spark, sf))
    back = kp.select(F.col("other").alias("label"), F.col("label").alias("other"), F.col("n").alias("m"))
    return kp.join(back, ["label", "other"]).select("label", "other", (F.col("n") - F.col("m")).alias("diff"))


@query(f"WITH {KNOWN}, df AS (SELECT (a.n - b.n)::DOUBLE AS v FROM kp a JOIN kp b ON a.label = b.other AND a.other = b.label), g AS (SELECT -20 + i * 2e0 AS x FROM (SELECT unnest(range(21)) AS i)) SELECT x, round(avg(exp(-pow((x - v) / 3, 2) / 2) / (3 * sqrt(2 * pi()))), 9) AS density FROM g CROSS JOIN df GROUP BY 1")
def difference_density(spark, sf):
    return detect.density(pair_differences(spark, sf), "diff", low=-20.0, high=20.0, points=21, width=3.0).select("x", F.round("density", 9).alias("density"))


PRUNED = PW + """, q AS (SELECT i, j, quantile_cont(abs(w), 75e-2) AS cut FROM pw GROUP BY 1, 2),
sp AS (SELECT i, j, d, w, CASE WHEN abs(w) >= cut - 1e-12 THEN w ELSE 0 END AS kept FROM pw JOIN q USING (i, j)),
pb AS (SELECT a.cls AS i, b.cls AS j, a.b - b.b AS b FROM cst a JOIN cst b ON a.cls < b.cls),
ds AS (SELECT o.ex, sp.i, sp.j, sum(sp.w) AS w, sum(sp.kept) AS kept FROM ones o JOIN sp ON sp.d = o.d AND o.cls IN (sp.i, sp.j) GROUP BY 1, 2, 3),
ps AS (SELECT e.label, CASE WHEN e.label = pb.i THEN pb.j ELSE pb.i END AS other, CASE WHEN e.label = pb.i THEN 1 ELSE -1 END AS y, round(b + coalesce(ds.w, 0), 9) AS w, round(b + coalesce(ds.kept, 0), 9) AS kept FROM embeddings e JOIN pb ON e.label IN (pb.i, pb.j) LEFT JOIN ds ON ds.ex = e.vec_id AND ds.i = pb.i AND ds.j = pb.j),
pd AS (SELECT label, other, (sum((y * kept < 0)::INT) - sum((y * w < 0)::INT))::BIGINT AS diff FROM ps GROUP BY 1, 2)"""


@query(f"WITH {PRUNED} SELECT label, other, diff FROM pd")
def pruned_pair_errors(spark, sf):
    """How many more errors the pair models make when the lower three quarters of their weights are set to 0."""
    const = classify.log_const(model(spark, sf))
    a, b = const.select(F.col("cls").alias("i"), F.col("b").alias("bi")), const.select(F.col("cls").alias("j"), F.col("b").alias("bj"))
    bias = a.join(b, F.col("i") < F.col("j")).select("i", "j", (F.col("bi") - F.col("bj")).alias("b"))
    weights = classify.pair_weights(model(spark, sf))
    errors = lambda w: models.pair_errors(examples(spark, sf), models.pair_row(w, bias))
    kept = errors(detect.sparsify(weights, 0.75)).withColumnRenamed("n", "kept")
    return errors(weights).join(kept, ["label", "other"]).select("label", "other", (F.col("kept") - F.col("n")).alias("diff"))


@query(f"WITH {PRUNED}, g AS (SELECT -20 + i * 2e0 AS x FROM (SELECT unnest(range(21)) AS i)) SELECT x, round(avg(exp(-pow((x - diff) / 3, 2) / 2) / (3 * sqrt(2 * pi()))), 9) AS density FROM g CROSS JOIN pd GROUP BY 1")
def pruned_error_density(spark, sf):
    return detect.density(pruned_pair_errors(spark, sf), "diff", low=-20.0, high=20.0, points=21, width=3.0).select("x", F.round("density", 9).alias("density"))


def _symbols(spark, sf):
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(F.col("user_id").alias("sig"), ord_.alias("ord"), F.col("event_type").alias("symbol"), s.alias("s"), (s + F.col("event_id") % 1000).alias("e"))


SYM = "sym AS (SELECT user_id AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS symbol, epoch_us(ts) AS s, epoch_us(ts) + event_id % 1000 AS e FROM events)"
SEQ = SYM + ", ld AS (SELECT *, lead(symbol, 1) OVER w AS b, lead(e, 1) OVER w AS last FROM sym WINDOW w AS (PARTITION BY sig ORDER BY ord)), seq AS (SELECT sig, s, last AS e FROM ld WHERE symbol = 'view' AND b = 'click')"


@query(f"WITH {SEQ} SELECT sig, s, e FROM seq")
def symbol_sequences(spark, sf):
    return detect.sequences(_symbols(spark, sf), ["view", "click"])


@query(f"WITH {SEQ}, l AS (SELECT max(e - s) AS longest FROM seq) SELECT sig, s, e, round(s - 3e-1 * (e - s), 1) AS ws, round(s + 3e-1 * (e - s) + longest, 1) AS we FROM seq CROSS JOIN l")
def context_windows(spark, sf):
    return detect.context(symbol_sequences(spark, sf)).select("sig", "s", "e", F.round("ws", 1).alias("ws"), F.round("we", 1).alias("we"))


TOL = 3_600_000_000


@query(f"""WITH {SYM}, dt AS (SELECT sig, ord AS det, s AS mid FROM sym WHERE symbol = 'view'), tr AS (SELECT sig, ord AS truth, s AS tmid FROM sym WHERE symbol = 'click'),
near AS (SELECT sig, det, truth, abs(mid - tmid) AS gap FROM dt JOIN tr USING (sig) WHERE abs(mid - tmid) <= {TOL}),
r AS (SELECT *, row_number() OVER (PARTITION BY sig, det ORDER BY gap, truth) AS a, row_number() OVER (PARTITION BY sig, truth ORDER BY gap, det) AS b FROM near),
h AS (SELECT sig, count(*) AS hits FROM r WHERE a = 1 AND b = 1 GROUP BY 1), nd AS (SELECT sig, count(*) AS d FROM dt GROUP BY 1), nt AS (SELECT sig, count(*) AS t FROM tr GROUP BY 1)
SELECT coalesce(nd.sig, nt.sig) AS sig, coalesce(hits, 0) AS hits, coalesce(d, 0) - coalesce(hits, 0) AS alarms, coalesce(t, 0) - coalesce(hits, 0) AS misses FROM nd FULL JOIN nt ON nd.sig = nt.sig LEFT JOIN h ON h.sig = coalesce(nd.sig, nt.sig)""")
def detection_outcomes(spark, sf):
    s = _symbols(spark, sf)
    return detect.outcomes(
        s.where("symbol = 'view'").select("sig", F.col("ord").alias("det"), F.col("s").alias("mid")),
        s.where("symbol = 'click'").select("sig", F.col("ord").alias("truth"), F.col("s").alias("tmid")),
        tolerance=TOL,
    )


@query("SELECT word, (row_number() OVER (ORDER BY word) - 1)::INT AS id FROM (SELECT DISTINCT event_type AS word FROM events)")
def word_ids(spark, sf):
    return detect.word_ids(F.col("event_type"), table(spark, sf, "events"))


SLIDE = CELL + """, hn AS (SELECT label AS cls, count(*) AS n FROM embeddings GROUP BY 1),
hk AS (SELECT o.cls, (c.t)::INT AS i, (c.f)::INT AS f, count(*) AS k FROM cell c JOIN (SELECT DISTINCT ex, cls FROM ones) o USING (ex) WHERE c.t < 4 GROUP BY 1, 2, 3),
hp AS (SELECT hn.cls, g.i, g.f, greatest(least(coalesce(k, 0) / n::DOUBLE, 99e-2), 1e-2) AS p FROM hn CROSS JOIN (SELECT a.i, b.f FROM (SELECT unnest(range(4))::INT AS i) a CROSS JOIN (SELECT unnest(range(8))::INT AS f) b) g LEFT JOIN hk ON hk.cls = hn.cls AND hk.i = g.i AND hk.f = g.f),
hb AS (SELECT cls, sum(ln(1 - p)) AS b FROM hp GROUP BY 1),
st AS (SELECT ex, t AS frame, f, unnest(range(greatest(0, t - 3), least(t, 4) + 1))::INT AS t FROM cell)"""


@query(f"WITH {SLIDE} SELECT ex, st.t, hp.cls, round(sum(ln(p) - ln(1 - p)) + min(b), 6) AS score FROM st JOIN hp ON hp.i = st.frame - st.t AND hp.f = st.f JOIN hb ON hb.cls = hp.cls GROUP BY 1, 2, 3")
def sliding_scores(spark, sf):
    """Templates of the first half of the frames, at every start."""
    half = classify.templates(examples(spark, sf).withColumn("idx", F.filter("idx", lambda i: i < DIM // 2)), DIM // 2)
    weights = classify.log_odds(half).select("cls", F.floor(F.col("d") / SIDE).cast("int").alias("i"), (F.col("d") % SIDE).alias("f"), "w")
    return detect.sliding_scores(cells(spark, sf), weights, classify.log_const(half), length=SIDE, size=SIDE // 2)


@query(f"WITH {SLIDE}, s AS (SELECT ex, st.t, hp.cls, round(sum(ln(p) - ln(1 - p)) + min(b), 6) AS score FROM st JOIN hp ON hp.i = st.frame - st.t AND hp.f = st.f JOIN hb ON hb.cls = hp.cls GROUP BY 1, 2, 3) SELECT ex, t, max(score) AS score FROM s GROUP BY 1, 2")
def sliding_best(spark, sf):
    return sliding_scores(spark, sf).groupBy("ex", "t").agg(F.max("score").alias("score"))


@query(f"WITH {PATCH}, c AS (SELECT ex, t, f, count(*) FILTER (WHERE d = 4) AS inner_on FROM patch GROUP BY 1, 2, 3) SELECT p.* FROM patch p JOIN c USING (ex, t, f) WHERE inner_on = 1")
def inner_patches(spark, sf):
    return patches.inner_full(placed(spark, sf), size=3, radius=0)


@query(f"""WITH {BITS}, o AS (SELECT i, j FROM (SELECT unnest(range(3))::INT AS i) CROSS JOIN (SELECT unnest(range(3))::INT AS j)),
patch AS (SELECT ex, (d // 16 - i)::INT AS t, (d // 4 % 4 - j)::INT AS f, ((i * 3 + j) * 4 + d % 4)::INT AS d FROM ones CROSS JOIN o WHERE d // 16 - i BETWEEN 0 AND 1 AND d // 4 % 4 - j BETWEEN 0 AND 1),
inside AS (SELECT ex, t, f FROM patch GROUP BY 1, 2, 3 HAVING count(DISTINCT d // 4) = 9),
part AS (SELECT k AS part, d, ((k * 7 + d * 5) % 11) / 5e0 - 1 AS w FROM (SELECT unnest(range(4))::INT AS k) CROSS JOIN (SELECT unnest(range(36))::INT AS d)),
s AS (SELECT p.ex, p.t, p.f, part.part, round(sum(part.w) - part.part / 10e0, 9) AS s FROM patch p SEMI JOIN inside USING (ex, t, f) JOIN part ON part.d = p.d GROUP BY 1, 2, 3, 4)
SELECT ex, t, f, part FROM (SELECT *, max(s) OVER (PARTITION BY ex, t, f) AS best FROM s) WHERE s = best""")
def inner_part_codes(spark, sf):
    """Best parts of the patches of four channels that have an edge in every cell within 1 of their centre."""
    d = F.col("d")
    on = examples(spark, sf).select("ex", F.explode("idx").alias("d")).select("ex", F.floor(d / 16).cast("int").alias("t"), (F.floor(d / 4) % 4).cast("int").alias("f"), (d % 4).alias("e"))
    inside = patches.inner_full(patches.channel_patches(on, height=4, width=4, size=3, channels=4), size=3, radius=1, channels=4)
    grid = spark.range(144).select(F.floor(F.col("id") / 36).cast("int").alias("part"), (F.col("id") % 36).cast("int").alias("d"))
    weights = grid.withColumn("w", ((F.col("part") * 7 + F.col("d") * 5) % 11) / 5.0 - 1)
    return patches.part_codes(inside, weights, spark.range(4).select(F.col("id").cast("int").alias("part"), (-F.col("id") / 10.0).alias("b")))


@query(f"WITH {PATCH}, n AS (SELECT ex, t, f, count(*) AS n FROM patch GROUP BY 1, 2, 3) SELECT a.ex, a.t, a.f, a.n FROM n a WHERE a.n >= 6 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.ex = a.ex AND abs(b.t - a.t) <= 1 AND abs(b.f - a.f) <= 1 AND b.n > a.n)")
def busy_local_maxima(spark, sf):
    return patches.local_maxima(placed(spark, sf)).where("n >= 6")


@query(f"WITH {TMPL}, y AS (SELECT vec_id AS ex, CASE WHEN label = 0 THEN 1 ELSE -1 END AS y FROM embeddings WHERE label < 2), s AS (SELECT o.ex, sum(a.w - b.w) / 8 AS s FROM ones o JOIN lo a ON a.d = o.d AND a.cls = 0 JOIN lo b ON b.d = o.d AND b.cls = 1 GROUP BY 1), z AS (SELECT y.ex, y.y, round(-y.y * coalesce(s, 0), 9) AS z FROM y LEFT JOIN s USING (ex)), p AS (SELECT *, CASE WHEN z > -75e-2 THEN 'error' WHEN abs(z + 1) <= 25e-2 THEN 'margin' END AS part FROM z) SELECT d, sum(-y)::BIGINT AS g FROM p JOIN ones USING (ex) WHERE part = 'error' GROUP BY 1")
def error_subgradient(spark, sf):
    """Sum of the signed features of the examples in error under the pair weights of the first two classes."""
    rows = F.broadcast(classify.weight_rows(classify.log_odds(model(spark, sf)), classify.log_const(model(spark, sf))))
    pair = rows.where("cls < 2").agg(F.max(F.when(F.col("cls") == 0, F.col("w"))).alias("w0"), F.max(F.when(F.col("cls") == 1, F.col("w"))).alias("w1"))
    dot = F.round(F.aggregate("idx", F.lit(0.0), lambda acc, i: acc + F.get("w0", i) - F.get("w1", i)) / 8, 9)
    two = examples(spark, sf).where("cls < 2").withColumn("y", F.when(F.col("cls") == 0, 1).otherwise(-1)).join(F.broadcast(pair))
    bad = detect.error_margin(two, dot, eps=0.25).where("part = 'error'")
    return bad.select(F.explode("idx").alias("d"), "y").groupBy("d").agg(F.sum(-F.col("y")).alias("g"))

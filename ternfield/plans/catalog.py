"""Registered queries: each name has a function over the tables and, where SQL can say it, its SQL.

``vec_id`` is the example, ``label`` its class and a feature is on where the embedding is positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ternfield.functions.features import path_id, set_bits, soft_bits, with_bias
from ternfield.operators import classify, iterate, patches, signal
from ternfield.sources.tables import svm_line, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIM, BASE, SCALE, SIDE = 64, 255, 4, 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.col("label").alias("cls"), set_bits(F.col("embedding")).alias("idx"))


def model(spark: SparkSession, sf: str) -> DataFrame:
    return classify.templates(examples(spark, sf), DIM)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return classify.scores(examples(spark, sf), model(spark, sf))


BITS = """bits AS (SELECT vec_id AS ex, label AS cls, unnest(range(len(embedding)))::INT AS d, unnest(embedding)::DOUBLE AS v FROM embeddings),
ones AS (SELECT ex, cls, d FROM bits WHERE v > 0)"""
TMPL = BITS + """,
n AS (SELECT label AS cls, count(*) AS n FROM embeddings GROUP BY 1),
grid AS (SELECT cls, n, unnest(range(64))::INT AS d FROM n),
seen AS (SELECT cls, d, count(*) AS k FROM ones GROUP BY 1, 2),
tmpl AS (SELECT g.cls, g.d, greatest(least(coalesce(s.k, 0) / g.n::DOUBLE, 99e-2), 1e-2) AS p FROM grid g LEFT JOIN seen s ON s.cls = g.cls AND s.d = g.d),
lo AS (SELECT cls, d, ln(p) - ln(1 - p) AS w FROM tmpl),
cst AS (SELECT cls, sum(ln(1 - p)) AS b FROM tmpl GROUP BY 1)"""
SC = TMPL + """,
dot AS (SELECT o.ex, l.cls, sum(l.w) AS s FROM ones o JOIN lo l ON l.d = o.d GROUP BY 1, 2),
sc AS (SELECT e.vec_id AS ex, e.label AS truth, c.cls, round(c.b + coalesce(t.s, 0), 9) AS score FROM embeddings e CROSS JOIN cst c LEFT JOIN dot t ON t.ex = e.vec_id AND t.cls = c.cls)"""
PRED = SC + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY score DESC, cls) AS rank FROM sc),
pred AS (SELECT ex, truth, cls AS guess FROM rk WHERE rank = 1),
conf AS (SELECT truth AS label, guess, count(*) AS n FROM pred GROUP BY 1, 2)"""


@query(f"WITH {BITS} SELECT e.vec_id AS ex, count(o.d) AS nnz, (sum(count(o.d)) OVER (ORDER BY e.vec_id) - count(o.d))::BIGINT AS row_start FROM embeddings e LEFT JOIN ones o ON o.ex = e.vec_id GROUP BY 1")
def binary_to_csr(spark, sf):
    """Row starts by two prefix sums: over blocks of ids, then inside a block."""
    rows = examples(spark, sf).select("ex", F.size("idx").cast("long").alias("nnz"), F.floor(F.col("ex") / 4096).alias("block"))
    totals = rows.groupBy("block").agg(F.sum("nnz").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("nnz").over(Window.partitionBy("block").orderBy("ex").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("block", before.alias("b")), "block").select("ex", "nnz", (F.col("b") + inside).alias("row_start"))


@query(f"WITH {BITS} SELECT ex, d FROM ones UNION ALL SELECT vec_id, 64 FROM embeddings")
def bias_append(spark, sf):
    return examples(spark, sf).select("ex", F.explode(with_bias(F.col("idx"), DIM)).alias("d"))


SOFT = BITS + ", soft AS (SELECT ex, d, least(255, floor(greatest(v, 0) * 4 * 255))::INT AS val FROM bits)"


@query(f"WITH {SOFT} SELECT ex, d, val FROM soft WHERE val >= 127")
def soft_to_hard(spark, sf):
    cells = F.filter(soft_bits(F.col("embedding"), BASE, SCALE), lambda c: c["val"] >= BASE // 2)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.explode(cells).alias("c")).select("ex", F.col("c.idx").alias("d"), "c.val")


@query(f"WITH {TMPL} SELECT cls, d, round(p, 9) AS p FROM tmpl")
def class_templates(spark, sf):
    return model(spark, sf).select("cls", "d", F.round("p", 9).alias("p"))


@query(f"WITH {TMPL} SELECT cls, d, round(w, 9) AS w FROM lo")
def log_odds(spark, sf):
    return classify.log_odds(model(spark, sf)).select("cls", "d", F.round("w", 9).alias("w"))


@query(f"WITH {TMPL} SELECT cls, round(b, 9) AS b FROM cst")
def log_const(spark, sf):
    return classify.log_const(model(spark, sf)).select("cls", F.round("b", 9).alias("b"))


@query(f"WITH {SC} SELECT ex, cls, round(score, 6) AS score FROM sc")
def model_loglikes(spark, sf):
    return scored(spark, sf).select("ex", "cls", F.round("score", 6).alias("score"))


@query(f"WITH {TMPL}, soft AS (SELECT ex, d, least(255, floor(greatest(v, 0) * 4 * 255))::INT AS val FROM bits) SELECT s.ex, l.cls, round(sum(l.w * s.val) / 255, 6) AS score FROM soft s JOIN lo l ON l.d = s.d GROUP BY 1, 2")
def soft_dotmm(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), soft_bits(F.col("embedding"), BASE, SCALE).alias("cells"))
    return classify.soft_scores(rows, model(spark, sf), BASE)


@query(f"WITH {PRED} SELECT ex, truth, guess FROM pred")
def predict(spark, sf):
    return classify.predict(scored(spark, sf))


@query(f"WITH {PRED} SELECT ex, cls, rank FROM rk WHERE rank <= 5")
def top5(spark, sf):
    return classify.ranked(scored(spark, sf)).where("rank <= 5").select("ex", "cls", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PRED}, k AS (SELECT unnest(range(1, 11)) AS k), own AS (SELECT rank FROM rk WHERE cls = truth) SELECT k.k, round(avg((own.rank <= k.k)::INT), 9) AS hit_rate FROM k CROSS JOIN own GROUP BY 1")
def topk_curve(spark, sf):
    ranks = classify.ranked(scored(spark, sf)).where("cls = truth").groupBy("rank").agg(F.count("*").alias("n"))
    ks = spark.range(1, 11).withColumnRenamed("id", "k")
    return ranks.join(F.broadcast(ks)).groupBy("k").agg(F.round(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("hit_rate"))


RIV = PRED + """,
riv AS (SELECT ex, max(score) FILTER (WHERE cls = truth) AS own, max(score) FILTER (WHERE cls <> truth) AS rival FROM sc GROUP BY 1)"""


@query(f"WITH {RIV} SELECT riv.ex, round(own, 6) AS own, min(sc.cls) AS rival_cls, round(rival, 6) AS rival FROM riv JOIN sc ON sc.ex = riv.ex AND sc.cls <> sc.truth AND sc.score = rival GROUP BY riv.ex, own, rival")
def rival_best(spark, sf):
    return classify.rivals(scored(spark, sf)).select("ex", F.round("own", 6).alias("own"), "rival_cls", F.round("rival", 6).alias("rival"))


@query(f"WITH {RIV} SELECT ex, round(1 + rival - own, 6) AS hinge FROM riv")
def hinge_loss(spark, sf):
    return classify.rivals(scored(spark, sf)).select("ex", "hinge")


@query(f"WITH {RIV}, h AS (SELECT round(1 + rival - own, 6) AS hinge, row_number() OVER (ORDER BY round(1 + rival - own, 6)) AS r, count(*) OVER () AS n FROM riv) SELECT hinge AS median FROM h WHERE r = n // 2 + 1")
def self_pace_k(spark, sf):
    return classify.upper_median(classify.rivals(scored(spark, sf)), "hinge")


@query(f"WITH {PRED} SELECT * FROM conf")
def confusion(spark, sf):
    return classify.confusion(classify.predict(scored(spark, sf)))


@query(f"WITH {PRED} SELECT r.x AS label, c.x AS guess, coalesce(conf.n, 0) AS n FROM (SELECT unnest(range((SELECT max(label) + 1 FROM conf)))::INT AS x) r CROSS JOIN (SELECT unnest(range((SELECT max(greatest(label, guess)) + 1 FROM conf)))::INT AS x) c LEFT JOIN conf ON conf.label = r.x AND conf.guess = c.x")
def confusion_dense(spark, sf):
    return classify.dense_confusion(classify.confusion(classify.predict(scored(spark, sf))))


@query(f"WITH {PRED} SELECT label, guess, round(n / sum(n) OVER (PARTITION BY label), 9) AS share FROM conf")
def confusion_norm(spark, sf):
    return classify.normalised(classify.confusion(classify.predict(scored(spark, sf))))


@query(f"WITH {PRED} SELECT round(avg((guess = truth)::INT), 9) AS accuracy FROM pred")
def accuracy(spark, sf):
    return classify.predict(scored(spark, sf)).agg(F.round(F.avg((F.col("guess") == F.col("truth")).cast("int")), 9).alias("accuracy"))


@query(f"WITH {PRED} SELECT truth AS label, round(avg((guess <> truth)::INT), 9) AS error, count(*) AS n FROM pred GROUP BY 1")
def class_errors(spark, sf):
    return classify.predict(scored(spark, sf)).groupBy(F.col("truth").alias("label")).agg(F.round(F.avg((F.col("guess") != F.col("truth")).cast("int")), 9).alias("error"), F.count("*").alias("n"))


@query(f"WITH {PRED} SELECT label // 2 AS coarse_label, guess // 2 AS coarse_guess, sum(n)::BIGINT AS n FROM conf GROUP BY 1, 2")
def reduce_confusion(spark, sf):
    mapping = spark.range(10).select(F.col("id").cast("int").alias("fine"), F.floor(F.col("id") / 2).cast("int").alias("coarse"))
    return classify.reduce_confusion(classify.confusion(classify.predict(scored(spark, sf))), mapping)


@query(f"WITH {PRED} SELECT round(sum(n) FILTER (WHERE label // 2 = guess // 2) / sum(n), 9) AS accuracy FROM conf")
def reduced_accuracy(spark, sf):
    cells = reduce_confusion(spark, sf)
    return cells.agg(F.round(F.sum(F.when(F.col("coarse_label") == F.col("coarse_guess"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("accuracy"))


@query("SELECT cr.n_regionkey AS coarse_label, sr.n_regionkey AS coarse_guess, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cr ON c_nationkey = cr.n_nationkey JOIN nation sr ON s_nationkey = sr.n_nationkey GROUP BY 1, 2")
def nation_region_confusion(spark, sf):
    """Nations of customers against those of suppliers, counted first and reduced to regions afterwards."""
    t = lambda n: table(spark, sf, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cells = lines.groupBy(F.col("c_nationkey").alias("label"), F.col("s_nationkey").alias("guess")).agg(F.count("*").alias("n"))
    return classify.reduce_confusion(cells, t("nation").select(F.col("n_nationkey").alias("fine"), F.col("n_regionkey").alias("coarse")))


@query(f"WITH {TMPL} SELECT a.cls AS i, b.cls AS j, a.d, round(a.w - b.w, 9) AS w FROM lo a JOIN lo b ON a.d = b.d AND a.cls < b.cls")
def pair_weights(spark, sf):
    return classify.pair_weights(model(spark, sf)).select("i", "j", "d", F.round("w", 9).alias("w"))


@query(f"WITH {TMPL} SELECT a.cls AS i, b.cls AS j, round(a.b - b.b, 9) AS b FROM cst a JOIN cst b ON a.cls < b.cls")
def pair_bias(spark, sf):
    c = classify.log_const(model(spark, sf))
    return c.select(F.col("cls").alias("i"), F.col("b").alias("bi")).join(c.select(F.col("cls").alias("j"), F.col("b").alias("bj")), F.col("i") < F.col("j")).select("i", "j", F.round(F.col("bi") - F.col("bj"), 9).alias("b"))


VOTE = SC + ", votes AS (SELECT a.ex, a.truth, a.cls, count(b.cls) FILTER (WHERE a.score > b.score) AS v FROM sc a JOIN sc b ON a.ex = b.ex GROUP BY 1, 2, 3)"


@query(f"WITH {VOTE}, r AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, cls) AS r FROM votes) SELECT ex, truth, cls AS guess FROM r WHERE r = 1")
def pair_vote_low(spark, sf):
    return classify.pair_votes(scored(spark, sf))


@query(f"WITH {VOTE}, r AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, cls DESC) AS r FROM votes) SELECT ex, truth, cls AS guess FROM r WHERE r = 1")
def pair_vote_high(spark, sf):
    return classify.pair_votes(scored(spark, sf), high_ties=True)


@query(f"WITH {SC}, own AS (SELECT ex, score AS own FROM sc WHERE cls = truth) SELECT truth AS label, cls AS other, count(*) FILTER (WHERE score > own) AS n FROM sc JOIN own USING (ex) WHERE cls <> truth GROUP BY 1, 2")
def known_pair_confusion(spark, sf):
    return classify.known_pairs(scored(spark, sf))


ASSIGN = SC + ", m AS (SELECT *, score - max(score) OVER (PARTITION BY ex) AS z FROM sc), asg AS (SELECT ex, truth, cls, exp(z) / sum(exp(z)) OVER (PARTITION BY ex) AS a FROM m WHERE z >= -138e-1)"


@query(f"WITH {ASSIGN} SELECT ex, round(coalesce(sum(a) FILTER (WHERE cls = truth), 0), 6) AS u FROM asg GROUP BY 1")
def uncertainty(spark, sf):
    own = F.sum(F.when(F.col("cls") == F.col("truth"), F.col("a")).otherwise(0.0))
    return classify.soft_assignment(scored(spark, sf)).groupBy("ex").agg(F.round(own, 6).alias("u"))


KL_MASS = """, mass AS (SELECT e.label AS cls, a.comp::INT AS comp, floor(round(sum(a.a), 6))::BIGINT AS n FROM a2 a JOIN embeddings e ON e.vec_id = a.ex GROUP BY 1, 2),
mf AS (SELECT cls, comp, (n + 5e-1) / sum(n) OVER (PARTITION BY cls) AS f FROM mass), kl AS (SELECT a.cls AS i, b.cls AS j, round(sum(a.f * (ln(a.f) - ln(b.f))), 9) AS kl FROM mf a JOIN mf b ON a.comp = b.comp GROUP BY 1, 2)"""


ZT = TMPL + """, zt AS (SELECT a.cls AS i, b.cls AS j, a.d, (a.p - b.p) / sqrt((a.p * na.n + b.p * nb.n) / (na.n + nb.n) * (1 - (a.p * na.n + b.p * nb.n) / (na.n + nb.n)) * (1e0 / na.n + 1e0 / nb.n)) AS z
FROM tmpl a JOIN tmpl b ON a.d = b.d AND a.cls < b.cls JOIN n na ON na.cls = a.cls JOIN n nb ON nb.cls = b.cls)"""


def z_scores(spark, sf):
    rows = examples(spark, sf)
    return classify.two_proportion(classify.templates(rows, DIM), rows.groupBy("cls").agg(F.count("*").alias("n")))


@query(f"WITH {ZT} SELECT i, j, d, round(z, 6) AS z FROM zt")
def z_test(spark, sf):
    return z_scores(spark, sf).select("i", "j", "d", F.round("z", 6).alias("z"))


@query(None)
def em_2iter(spark, sf):
    soft, _ = iterate.em(examples(spark, sf), DIM, 3, rounds=2)
    return soft.select("ex", F.posexplode("a").alias("comp", "a")).select("ex", "comp", F.round("a", 6).alias("a"))


def _em_sql(rounds: int) -> str:
    parts = [BITS, "a0 AS (SELECT vec_id AS ex, c.c AS comp, (vec_id % 3 = c.c)::INT::DOUBLE AS a FROM embeddings CROSS JOIN (SELECT unnest(range(3)) AS c) c)"]
    for r in range(rounds):
        parts += [
            f"t{r} AS MATERIALIZED (SELECT comp, sum(a) AS t FROM a{r} GROUP BY 1)",
            f"p{r} AS MATERIALIZED (SELECT a.comp, o.d, greatest(least(sum(a.a) / min(t.t), 99e-2), 1e-2) AS p FROM a{r} a JOIN ones o ON o.ex = a.ex JOIN t{r} t ON t.comp = a.comp GROUP BY 1, 2)",
            f"k{r} AS MATERIALIZED (SELECT p.comp, sum(ln(1 - p.p)) + ln(min(t.t) / (SELECT sum(t) FROM t{r})) AS b FROM p{r} p JOIN t{r} t ON t.comp = p.comp GROUP BY 1)",
            f"z{r} AS MATERIALIZED (SELECT e.vec_id AS ex, k.comp, k.b + coalesce(s.s, 0) AS z FROM embeddings e CROSS JOIN k{r} k LEFT JOIN (SELECT o.ex, p.comp, sum(ln(p.p) - ln(1 - p.p)) AS s FROM ones o JOIN p{r} p ON p.d = o.d GROUP BY 1, 2) s ON s.ex = e.vec_id AND s.comp = k.comp)",
            f"x{r} AS MATERIALIZED (SELECT ex, max(z) AS m FROM z{r} GROUP BY 1)",
            f"s{r} AS MATERIALIZED (SELECT z.ex, x.m + ln(sum(exp(z.z - x.m))) AS l FROM z{r} z JOIN x{r} x ON x.ex = z.ex GROUP BY z.ex, x.m)",
            f"a{r + 1} AS MATERIALIZED (SELECT z.ex, z.comp, exp(z.z - s.l) AS a FROM z{r} z JOIN s{r} s ON s.ex = z.ex)",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a{rounds}"


ORACLE["em_2iter"] = _em_sql(2)
#: Log likelihoods by round, up to the first that gains too little.
CONVERGED = ", hist AS (" + " UNION ALL ".join(f"SELECT {r} AS round, sum(l) AS l FROM s{r}" for r in range(8)) + """),
gain AS (SELECT *, lag(l) OVER (ORDER BY round) AS was FROM hist), stop AS (SELECT coalesce(min(round), 7) AS last FROM gain WHERE l - was <= -1e-6 * was) SELECT round, round(l, 4) AS loglik FROM hist, stop WHERE round <= last"""


@query(_em_sql(8).replace(" SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a8", CONVERGED))
def em_converged(spark, sf):
    _, history = iterate.em(examples(spark, sf), DIM, 3, rounds=8, tol=1e-6)
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(history)], "round int, loglik double")


@query(None)
def pegasos_3step(spark, sf):
    rows = examples(spark, sf).select("idx", F.when(F.col("cls") < 5, 1).otherwise(-1).alias("y"))
    w = iterate.pegasos(rows, DIM)
    return spark.createDataFrame([(d, round(float(x), 9)) for d, x in enumerate(w)], "d int, w double")


def _pegasos_sql(steps: int) -> str:
    parts = [BITS, "y AS (SELECT vec_id AS ex, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings)", "w0 AS (SELECT unnest(range(64))::INT AS d, 0e0 AS w)"]
    for t in range(steps):
        parts += [
            f"v{t} AS MATERIALIZED (SELECT y.ex, y.y FROM y LEFT JOIN (SELECT o.ex, sum(w.w) AS s FROM ones o JOIN w{t} w ON w.d = o.d GROUP BY 1) s ON s.ex = y.ex WHERE y.y * coalesce(s.s, 0) < 1)",
            f"w{t + 1} AS MATERIALIZED (SELECT w.d, (1 - 1e0 / {t + 1}) * w.w + 1e0 / (2 * {t + 1}) / (SELECT count(*) FROM embeddings) * coalesce(g.g, 0) AS w FROM w{t} w LEFT JOIN (SELECT o.d, sum(v.y) AS g FROM ones o JOIN v{t} v ON v.ex = o.ex GROUP BY 1) g ON g.d = w.d)",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT d, round(w, 9) AS w FROM w{steps}"


ORACLE["pegasos_3step"] = _pegasos_sql(3)

def cells(spark, sf):
    return classify.ones(examples(spark, sf)).select("ex", F.floor(F.col("d") / SIDE).cast("int").alias("t"), (F.col("d") % SIDE).alias("f"))


CELL = BITS + ", cell AS (SELECT ex, d // 8 AS t, d % 8 AS f FROM ones)"
PATCH = CELL + ", o AS (SELECT i, j FROM (SELECT unnest(range(3))::INT AS i) CROSS JOIN (SELECT unnest(range(3))::INT AS j)), patch AS (SELECT ex, (t - i)::INT AS t, (f - j)::INT AS f, (i * 3 + j)::INT AS d FROM cell CROSS JOIN o WHERE t - i BETWEEN 0 AND 5 AND f - j BETWEEN 0 AND 5)"


def placed(spark, sf):
    return patches.patches(cells(spark, sf), height=SIDE, width=SIDE, size=3)


@query(f"WITH {PATCH} SELECT * FROM patch")
def patch_matrix(spark, sf):
    return placed(spark, sf)


@query(f"WITH {PATCH}, part AS (SELECT k AS part, d, ((k * 7 + d * 5) % 11) / 5e0 - 1 AS w FROM (SELECT unnest(range(4))::INT AS k) CROSS JOIN (SELECT unnest(range(9))::INT AS d)), s AS (SELECT p.ex, p.t, p.f, part.part, round(sum(part.w) - part.part / 10e0, 9) AS s, count(*) AS n FROM patch p JOIN part ON part.d = p.d GROUP BY 1, 2, 3, 4), m AS (SELECT *, max(s) OVER (PARTITION BY ex, t, f) AS best FROM s) SELECT ex, t, f, part FROM m WHERE s = best AND n >= 3 AND best >= 1")
def part_codes(spark, sf):
    grid = spark.range(36).select(F.floor(F.col("id") / 9).cast("int").alias("part"), (F.col("id") % 9).cast("int").alias("d"))
    weights = grid.withColumn("w", ((F.col("part") * 7 + F.col("d") * 5) % 11) / 5.0 - 1)
    const = spark.range(4).select(F.col("id").cast("int").alias("part"), (-F.col("id") / 10.0).alias("b"))
    return patches.part_codes(placed(spark, sf), weights, const, count_threshold=3, likelihood_threshold=1.0)


@query(f"WITH {CELL}, o AS (SELECT unnest(range(-1, 2))::INT AS i), r AS (SELECT DISTINCT ex, (t + a.i)::INT AS t, (f + b.i)::INT AS f FROM cell CROSS JOIN o a CROSS JOIN o b) SELECT * FROM r WHERE t BETWEEN 0 AND 7 AND f BETWEEN 0 AND 7")
def max_spread(spark, sf):
    return patches.spread(cells(spark, sf), radius=1, height=SIDE, width=SIDE)


@query(f"WITH {PATCH}, n AS (SELECT ex, t, f, count(*) AS n FROM patch GROUP BY 1, 2, 3) SELECT a.ex, a.t, a.f, a.n FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.ex = a.ex AND abs(b.t - a.t) <= 1 AND abs(b.f - a.f) <= 1 AND b.n > a.n)")
def local_max_patches(spark, sf):
    return patches.local_maxima(placed(spark, sf))


def wave(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select(F.col("user_id").alias("sig"), n.cast("long").alias("n"), F.col("value").alias("x"))


WAVE = "wave AS (SELECT user_id AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"


@query(f"WITH {WAVE} SELECT sig, n, round(x - 95e-2 * coalesce(lag(x) OVER (PARTITION BY sig ORDER BY n), 0), 6) AS y FROM wave")
def preemphasis(spark, sf):
    return signal.preemphasis(wave(spark, sf))


@query(f"WITH {WAVE} SELECT sig, n, round(x / nullif(stddev_pop(x) OVER (PARTITION BY sig), 0), 6) AS y FROM wave")
def standardise(spark, sf):
    return signal.standardise(wave(spark, sf))


FRAME = WAVE + """, len AS (SELECT sig, count(*) AS len FROM wave GROUP BY 1 HAVING count(*) > 16), pl AS (SELECT sig, len, unnest(range(floor(5e-1 + len / 16e0 * 2)::BIGINT))::INT AS t FROM len),
pk AS (SELECT *, unnest(range(16))::INT AS k FROM pl), ix AS (SELECT sig, t, k, CASE WHEN t * 8 + k - 8 < 0 THEN 8 - t * 8 - k WHEN t * 8 + k - 8 > len - 1 THEN 2 * len - 2 - (t * 8 + k - 8) ELSE t * 8 + k - 8 END AS n FROM pk),
frame AS (SELECT sig, t, k, x FROM ix JOIN wave USING (sig, n))"""


@query(f"WITH {FRAME} SELECT sig, t, k, x FROM frame")
def frames(spark, sf):
    return signal.frames(wave(spark, sf))


@query(f"WITH {FRAME}, fr AS (SELECT unnest(range(9))::INT AS f) SELECT sig, t, f, round(sqrt(pow(sum(x * cos(k * f * pi() / 8)), 2) + pow(sum(x * sin(k * f * pi() / 8)), 2)), 5) AS v FROM frame CROSS JOIN fr GROUP BY 1, 2, 3")
def dft16(spark, sf):
    return signal.spectrum(signal.frames(wave(spark, sf)))


@query(f"WITH {WAVE} SELECT sig, n, round((3 * x + 2 * (coalesce(lag(x, 1) OVER w, 0) + coalesce(lead(x, 1) OVER w, 0)) + coalesce(lag(x, 2) OVER w, 0) + coalesce(lead(x, 2) OVER w, 0)) / 9, 6) AS y FROM wave WINDOW w AS (PARTITION BY sig ORDER BY n)")
def smooth_signal(spark, sf):
    return signal.smooth(wave(spark, sf))


@query(f"WITH {WAVE}, m AS (SELECT *, max(x) OVER (PARTITION BY sig ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM wave) SELECT sig, n, x FROM m WHERE x >= top AND x > 0")
def peaks(spark, sf):
    return signal.peaks(wave(spark, sf))


@query(f"WITH {WAVE}, len AS (SELECT sig, count(*) AS len FROM wave GROUP BY 1 HAVING count(*) > 9), c AS (SELECT sig, n AS c, len, unnest(range(9))::INT AS k FROM wave JOIN len USING (sig) WHERE n % 10 = 0), i AS (SELECT sig, c, k, CASE WHEN c + k - 4 < 0 THEN 4 - c - k WHEN c + k - 4 > len - 1 THEN 2 * len - 2 - (c + k - 4) ELSE c + k - 4 END AS n FROM c) SELECT sig, c, k, x FROM i JOIN wave USING (sig, n)")
def window_cut(spark, sf):
    w = wave(spark, sf)
    return signal.cut(w, w.where(F.col("n") % 10 == 0).select("sig", F.col("n").alias("c")), length=9)


TR = "tr AS (SELECT conv_id, turn, role AS label, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS s, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS e FROM conversations)"


def segments(spark, sf):
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("label"), (end - F.length("text")).alias("s"), end.alias("e"))


@query(f"WITH {TR} SELECT * FROM tr")
def transcript(spark, sf):
    return segments(spark, sf)


@query(f"WITH {TR} SELECT conv_id, turn, s, e, t FROM (SELECT *, greatest(0, ceil((s + e) / 2e0 / 80 - 5e-1))::BIGINT AS t FROM tr)")
def nearest_frame(spark, sf):
    return signal.nearest_frame(segments(spark, sf), hop=80).select("conv_id", "turn", "s", "e", "t")


@query(f"WITH {TR}, x AS (SELECT *, lead(label) OVER w AS l2, lead(e) OVER w AS e2 FROM tr WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, s, e2 AS e FROM x WHERE label = 'user' AND l2 = 'assistant'")
def label_sequence(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = segments(spark, sf).withColumns({"l2": F.lead("label").over(w), "e2": F.lead("e").over(w)})
    return x.where((F.col("label") == "user") & (F.col("l2") == "assistant")).select("conv_id", "turn", "s", F.col("e2").alias("e"))


@query("SELECT role AS label, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, count(*) AS n FROM conversations GROUP BY 1")
def length_stats(spark, sf):
    n = F.length("text").cast("long")
    return table(spark, sf, "conversations").groupBy(F.col("role").alias("label")).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.count("*").alias("n"))


EV = "ev AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)"


@query(f"WITH {EV}, c AS (SELECT state AS prev, nxt AS next, count(*) AS n FROM ev WHERE nxt IS NOT NULL GROUP BY 1, 2) SELECT prev, next, round(n / sum(n) OVER (PARTITION BY prev), 9) AS p FROM c")
def transition_matrix(spark, sf):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = table(spark, sf, "events").select(F.col("event_type").alias("prev"), nxt.alias("next")).where("next IS NOT NULL").groupBy("prev", "next").agg(F.count("*").alias("n"))
    return c.select("prev", "next", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prev")), 9).alias("p"))


@query("SELECT event_type AS symbol, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def symbol_stats(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def intervals(spark, sf):
    return wave(spark, sf).select("sig", (F.col("n") * 3).alias("start"), (F.col("n") * 3 + 1 + F.floor(F.col("x") * 10).cast("long") % 7).alias("end"), F.col("x").alias("score"))


IV = WAVE + """, iv AS (SELECT sig, n * 3 AS start, n * 3 + 1 + floor(x * 10)::BIGINT % 7 AS "end", x AS score FROM wave),
h AS (SELECT sig, min({'e': "end", 's': start}) AS m FROM iv GROUP BY 1 UNION ALL SELECT iv.sig, min({'e': iv."end", 's': iv.start}) FROM h JOIN iv ON iv.sig = h.sig AND iv.start >= h.m.e GROUP BY 1)"""


@query(f'WITH RECURSIVE {IV} SELECT sig, m.s AS start, m.e AS "end" FROM h')
def interval_heads(spark, sf):
    return signal.heads(intervals(spark, sf))


@query(f"""WITH RECURSIVE {IV}, o AS (SELECT iv.sig, start, "end", score, m.s AS head, row_number() OVER (PARTITION BY iv.sig, start, "end", score ORDER BY least("end", m.e) - greatest(start, m.s) DESC, m.s) AS r FROM iv JOIN h ON h.sig = iv.sig AND least("end", m.e) > greatest(start, m.s))
SELECT sig, head, min(start) AS start, max("end") AS "end", max(score) AS score FROM o WHERE r = 1 GROUP BY 1, 2""")
def cluster_representatives(spark, sf):
    i = intervals(spark, sf)
    return signal.representatives(signal.assign(i, signal.heads(i)))


@query(f"WITH {WAVE}, g AS (SELECT round(x, 1) AS score, sum((n % 3 = 0)::INT) AS h, sum((n % 3 <> 0)::INT) AS a FROM wave GROUP BY 1) SELECT score, (sum(h) OVER (ORDER BY score DESC))::BIGINT AS hits, (sum(a) OVER (ORDER BY score DESC))::BIGINT AS alarms FROM g")
def roc(spark, sf):
    return signal.roc(wave(spark, sf).select(F.round("x", 1).alias("score"), (F.col("n") % 3 == 0).alias("hit")))


@query("SELECT page_id, regexp_replace(array_to_string(list_slice(string_split(url, '/'), -3, -1), '_'), '\\.html$', '') AS uttid FROM pages")
def parse_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", path_id(F.col("url"), "\\.html").alias("uttid"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def speaker_semi(spark, sf):
    keep = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf, "events").select("event_id", "user_id").join(keep, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS comp FROM part")
def component_renumber(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long").alias("comp"))


@query(f"WITH {SOFT} SELECT e.vec_id AS ex, e.label || ' ' || string_agg((d + 1) || ':' || val, ' ' ORDER BY d) AS line FROM soft JOIN embeddings e ON e.vec_id = soft.ex GROUP BY e.vec_id, e.label")
def svm_text(spark, sf):
    val = F.transform("embedding", lambda v: F.least(F.lit(BASE), F.floor(F.greatest(v.cast("double"), F.lit(0.0)) * SCALE * BASE)).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), svm_line(F.col("label"), val).alias("line"))


@query("SELECT l.doc_id, l.quality, round(ln(d.n_chars), 9) AS f1, round(ln(d.n_chars) * ln(d.n_chars), 6) AS f2 FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.n_chars > 0")
def length_features(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").where("n_chars > 0")
    ln = F.ln("n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "quality", F.round(ln, 9).alias("f1"), F.round(ln * ln, 6).alias("f2"))


@query("SELECT vec_id AS ex FROM embeddings WHERE vec_id % 5 < 4")
def union_split(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"))
    return e.where(F.col("ex") % 5 < 3).unionByName(e.where(F.col("ex") % 5 == 3))


@query("SELECT o_custkey FROM orders GROUP BY 1 EXCEPT SELECT user_id FROM events")
def missing_items(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(seen, "o_custkey", "left_anti")


@query("SELECT i.i, j.j, round(exp(-((i.i - 4) * (i.i - 4) + (j.j - 4) * (j.j - 4)) / 4e0), 9) AS v FROM (SELECT unnest(range(8))::INT AS i) i CROSS JOIN (SELECT unnest(range(8))::INT AS j) j")
def gauss_kernel(spark, sf):
    g = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("i"), (F.col("id") % 8).cast("int").alias("j"))
    return g.withColumn("v", F.round(F.exp(-(F.pow(F.col("i") - 4, 2) + F.pow(F.col("j") - 4, 2)) / 4.0), 9))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10")
def cap_sample(spark, sf):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("source", "doc_id", "n_chars").withColumn("r", r).where("r <= 10").select("source", "doc_id")

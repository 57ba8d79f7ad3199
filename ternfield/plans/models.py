"""Queries over models of several components, their votes and statistics, row selection, searches and places."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ternfield.functions.features import path_id, soft_bits
from ternfield.operators import classify, detect, iterate, models, nearest, patches, positions, signal
from ternfield.plans.catalog import BASE, BITS, DIM, KL_MASS, SC, SCALE, TMPL, TR, WAVE, _em_sql, examples, model, query, scored, segments, wave
from ternfield.sources.scratch import written
from ternfield.sources.tables import table


def parts(spark, sf):
    """Examples with two components a class, by the parity of the id."""
    return examples(spark, sf).withColumn("comp", (F.col("ex") % 2).cast("int"))


def component_model(spark, sf):
    return models.component_templates(parts(spark, sf), DIM)


CT = BITS + """,
cn AS (SELECT label AS cls, (vec_id % 2)::INT AS comp, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label) AS weight FROM embeddings GROUP BY 1, 2),
cg AS (SELECT cls, comp, n, weight, unnest(range(64))::INT AS d FROM cn),
cs AS (SELECT cls, (ex % 2)::INT AS comp, d, count(*) AS k FROM ones GROUP BY 1, 2, 3),
ct AS (SELECT g.cls, g.comp, g.d, greatest(least(coalesce(s.k, 0) / g.n::DOUBLE, 99e-2), 1e-2) AS p, weight FROM cg g LEFT JOIN cs s ON s.cls = g.cls AND s.comp = g.comp AND s.d = g.d)"""
CSC = CT + """,
cb AS (SELECT cls, comp, sum(ln(1 - p)) + ln(min(weight)) AS b FROM ct GROUP BY 1, 2),
cd AS (SELECT o.ex, c.cls, c.comp, sum(ln(p) - ln(1 - p)) AS s FROM ones o JOIN ct c ON c.d = o.d GROUP BY 1, 2, 3),
csc AS (SELECT e.vec_id AS ex, e.label AS truth, cb.cls, cb.comp, round(cb.b + coalesce(cd.s, 0), 9) AS score FROM embeddings e CROSS JOIN cb LEFT JOIN cd ON cd.ex = e.vec_id AND cd.cls = cb.cls AND cd.comp = cb.comp)"""


@query(f"WITH {CT} SELECT cls, comp, d, round(p, 9) AS p, round(weight, 9) AS weight FROM ct")
def component_templates(spark, sf):
    return component_model(spark, sf).select("cls", "comp", "d", F.round("p", 9).alias("p"), F.round("weight", 9).alias("weight"))


@query(f"WITH {CSC} SELECT ex, cls, comp, round(score, 6) AS score FROM csc")
def component_loglikes(spark, sf):
    return models.component_scores(parts(spark, sf), component_model(spark, sf)).select("ex", "cls", "comp", F.round("score", 6).alias("score"))


@query(f"""WITH {CSC}, o AS (SELECT ex, comp, score, row_number() OVER (PARTITION BY ex ORDER BY score DESC, cls, comp) AS r FROM csc WHERE cls = truth),
q AS (SELECT ex, cls, comp, score, row_number() OVER (PARTITION BY ex ORDER BY score DESC, cls, comp) AS r FROM csc WHERE cls <> truth)
SELECT o.ex, o.comp AS own_comp, round(o.score, 6) AS own, q.cls AS rival_cls, q.comp AS rival_comp, round(q.score, 6) AS rival FROM o JOIN q ON q.ex = o.ex AND q.r = 1 WHERE o.r = 1""")
def best_components(spark, sf):
    best = models.best_components(models.component_scores(parts(spark, sf), component_model(spark, sf)))
    return best.withColumns({c: F.round(c, 6) for c in ("own", "rival")})


@query(f"""WITH {CSC}, b AS (SELECT *, max(score) FILTER (WHERE cls = truth) OVER (PARTITION BY ex) AS t, max(score) FILTER (WHERE cls <> truth) OVER (PARTITION BY ex) AS f FROM csc),
z AS (SELECT ex, cls, comp, cls = truth AS own, (1 + f - t) / 3e0 AS extra, CASE WHEN cls = truth THEN (score - t) / 2e0 ELSE (score - f) / 3e0 END AS z FROM b)
SELECT ex, cls, comp, own, round(exp(z) / (sum(exp(z)) OVER (PARTITION BY ex, own) + CASE WHEN own THEN 0 ELSE exp(-extra) END), 6) AS a FROM z WHERE z > -138e-1 AND extra > -138e-1""")
def smoothed_assign(spark, sf):
    soft = models.smoothed_assignments(models.component_scores(parts(spark, sf), component_model(spark, sf)), beta=2.0, gamma=3.0)
    return soft.withColumn("a", F.round("a", 6))


@query('SELECT cls, comp, row_number() OVER (ORDER BY cls, comp) - 1 AS place FROM (SELECT DISTINCT label AS cls, (vec_id % 2)::INT AS comp FROM embeddings)')
def model_columns(spark, sf):
    return models.model_columns(component_model(spark, sf)).select("cls", "comp", F.col("column").cast("long").alias("place"))


@query(f"WITH {CT}, u AS (SELECT unnest([7, 3, 1]) AS old, unnest([0, 1, 2]) AS cls) SELECT u.cls, comp, d, round(p, 9) AS p FROM ct JOIN u ON u.old = ct.cls")
def selected_rows(spark, sf):
    return models.selected_rows(component_model(spark, sf), [7, 3, 1]).select("cls", "comp", "d", F.round("p", 9).alias("p"))


@query("SELECT DISTINCT (vec_id % 2)::INT AS comp FROM embeddings WHERE label = 3")
def label_components(spark, sf):
    return models.label_components(component_model(spark, sf), 3)


@query('SELECT cls, comp, row_number() OVER (ORDER BY cls, comp) - 1 AS "row" FROM (SELECT DISTINCT label AS cls, (vec_id % 2)::INT AS comp FROM embeddings)')
def ordered_rows(spark, sf):
    return models.ordered_rows(component_model(spark, sf)).withColumn("row", F.col("row").cast("long"))


@query(f"WITH {TMPL} SELECT g.cls, g.d, round(greatest(least(coalesce(s.k, 0) / g.n::DOUBLE, 1 - 1 / (2e0 * g.n)), 1 / (2e0 * g.n)), 9) AS p FROM grid g LEFT JOIN seen s ON s.cls = g.cls AND s.d = g.d")
def size_clipped_templates(spark, sf):
    return models.size_clipped(examples(spark, sf), DIM).withColumn("p", F.round("p", 9))


@query(f"WITH {BITS} SELECT ex, d, round(v / (1 + d), 9) AS v FROM bits")
def weighted_features(spark, sf):
    weights = spark.range(DIM).select(F.col("id").cast("int").alias("d"), (1 / (1 + F.col("id"))).alias("w"))
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.posexplode("embedding").alias("d", "x")).select("ex", "d", F.col("x").cast("double").alias("v"))
    return models.weighted_features(cells, weights).withColumn("v", F.round("v", 9))


@query(f"WITH {BITS}, s AS (SELECT ex, d, least(255, floor(greatest(v, 0) * 4 * 255))::INT AS val FROM bits) SELECT ex, d, val FROM s WHERE val > 0 UNION ALL SELECT vec_id, 64, 255 FROM embeddings")
def soft_bias(spark, sf):
    cells = models.with_soft_bias(soft_bits(F.col("embedding"), BASE, SCALE), DIM, BASE)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.explode(cells).alias("c")).select("ex", F.col("c.idx").alias("d"), "c.val")


VOTES = SC + """, pm AS (SELECT ex, truth, i, j, round(b + coalesce(s, 0), 9) AS score FROM (SELECT e.vec_id AS ex, e.label AS truth, a.cls AS i, c.cls AS j, a.b - c.b AS b, (SELECT 0) AS z FROM embeddings e CROSS JOIN cst a JOIN cst c ON a.cls < c.cls) x
LEFT JOIN (SELECT o.ex, p.i, p.j, sum(p.w) AS s FROM ones o JOIN (SELECT a.cls AS i, b.cls AS j, a.d, a.w - b.w AS w FROM lo a JOIN lo b ON a.d = b.d AND a.cls < b.cls) p ON p.d = o.d GROUP BY 1, 2, 3) y USING (ex, i, j)),
vt AS (SELECT ex, truth, cls, sum(v) AS v FROM (SELECT ex, truth, i AS cls, (score > 0)::INT AS v FROM pm UNION ALL SELECT ex, truth, j, (score < 0)::INT FROM pm) GROUP BY 1, 2, 3)"""


def _pair_row(spark, sf):
    weights, c = classify.pair_weights(model(spark, sf)), classify.log_const(model(spark, sf))
    bias = c.select(F.col("cls").alias("i"), F.col("b").alias("bi")).join(c.select(F.col("cls").alias("j"), F.col("b").alias("bj")), F.col("i") < F.col("j")).select("i", "j", (F.col("bi") - F.col("bj")).alias("b"))
    return models.pair_row(weights, bias)


@query(f"WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, cls) AS r FROM vt) SELECT ex, truth, cls AS guess FROM r WHERE r = 1")
def model_vote_low(spark, sf):
    return models.pair_guesses(examples(spark, sf), _pair_row(spark, sf))


@query(f"WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, cls DESC) AS r FROM vt) SELECT ex, truth, cls AS guess FROM r WHERE r = 1")
def model_vote_high(spark, sf):
    return models.pair_guesses(examples(spark, sf), _pair_row(spark, sf), high_ties=True)


@query("WITH c AS (SELECT DISTINCT label AS c FROM embeddings), p AS (SELECT a.c AS i, b.c AS j FROM c a JOIN c b ON a.c < b.c) SELECT i, j, i AS cls, 1 AS sign FROM p UNION ALL SELECT i, j, j, -1 FROM p")
def vote_signs(spark, sf):
    return models.vote_signs(classify.pair_weights(model(spark, sf)))


MASSES = _em_sql(2).replace(" SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a2", KL_MASS)


def _masses(spark, sf):
    soft, _ = iterate.em(examples(spark, sf), DIM, 3, rounds=2)
    return models.class_masses(soft)


@query(f"{MASSES} SELECT cls, comp, n FROM mass")
def class_masses(spark, sf):
    return _masses(spark, sf)


@query(f"{MASSES} SELECT i, j, kl FROM kl")
def kl_matrix(spark, sf):
    return models.mass_divergence(_masses(spark, sf))


@query(f"{MASSES} SELECT i, j, round(exp(-kl), 6) AS w FROM kl WHERE exp(-kl) >= 6e-1 AND i <> j")
def kl_graph(spark, sf):
    return models.similarity_graph(models.mass_divergence(_masses(spark, sf))).withColumn("w", F.round("w", 6))


@query(None)
def kl_order(spark, sf):
    """Classes in reverse Cuthill-McKee order of their similarity graph."""
    kl = models.mass_divergence(_masses(spark, sf))
    edges = [(r["i"], r["j"]) for r in models.similarity_graph(kl).select("i", "j").collect()]
    nodes = sorted(r["i"] for r in kl.select("i").distinct().collect())
    return spark.createDataFrame(list(enumerate(models.reordered(edges, nodes))), "place int, cls int")


#: Fixed list of short words, whose presence tells languages apart.
MARKERS = ("the", "and", "of", "la", "de", "le", "und", "die", "el", "que", "in", "en")
LANG = f"""wl AS (SELECT unnest({list(MARKERS)}) AS word, unnest(range({len(MARKERS)}))::INT AS d), dl AS (SELECT lang AS cls, string_split(lower(coalesce(text, '')), ' ') AS ws FROM documents),
ln AS (SELECT cls, count(*) AS n FROM dl GROUP BY 1), lc AS (SELECT cls, d, sum(list_contains(ws, word)::INT) AS k FROM dl CROSS JOIN wl GROUP BY 1, 2),
lp AS (SELECT lc.cls, d, greatest(least(k / n::DOUBLE, 99e-2), 1e-2) AS p, n FROM lc JOIN ln USING (cls)),
lz AS (SELECT a.cls AS i, b.cls AS j, a.d, (a.p - b.p) / sqrt((a.p * a.n + b.p * b.n) / (a.n + b.n) * (1 - (a.p * a.n + b.p * b.n) / (a.n + b.n)) * (1e0 / a.n + 1e0 / b.n)) AS z FROM lp a JOIN lp b ON a.d = b.d AND a.cls < b.cls),
lt AS (SELECT *, 1 / (1 + abs(z) / sqrt(2e0) / 2) AS t FROM lz),
pv AS (SELECT i, j, d, t * exp(-z * z / 2 - 126551223e-8 + t * (100002368e-8 + t * (37409196e-8 + t * (9678418e-8 + t * (-18628806e-8 + t * (27886807e-8 + t * (-113520398e-8 + t * (148851587e-8 + t * (-82215223e-8 + t * 17087277e-8))))))))) AS p FROM lt)"""


def _language_tests(spark, sf):
    """(i, j, d, p): whether two languages differ in the share of documents that hold a word."""
    held = F.filter(F.transform(F.array(*[F.contains("ws", F.lit(f" {w} ")).alias(w) for w in MARKERS]), lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    rows = table(spark, sf, "documents").select(F.col("lang").alias("cls"), F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")).alias("ws")).select("cls", held.alias("idx"))
    # texts are read once: what follows needs only how many documents of a language hold each set of words, at most 2^12 a language
    sets = written(rows.groupBy("cls", "idx").agg(F.count("*").alias("n")), "word-sets")
    sizes = sets.groupBy("cls").agg(F.sum("n").alias("n"))
    z = classify.two_proportion(classify.templates(sets, len(MARKERS), weight="n"), sizes)
    return written(z.select("i", "j", "d", models.two_sided_p(F.col("z")).alias("p")), "language-tests")


@query(f"WITH {LANG} SELECT i, j, d, round(p, 9) AS p FROM pv")
def p_values(spark, sf):
    return _language_tests(spark, sf).withColumn("p", F.round("p", 9))


@query(f"WITH {LANG}, r AS (SELECT *, round(p, 12) AS q FROM pv), k AS (SELECT q, count(*) OVER (ORDER BY q) AS k, count(*) OVER () AS m FROM r) SELECT i, j, d FROM r WHERE q <= (SELECT max(q) FROM k WHERE q <= k * 5e-2 / m)")
def bh_fdr(spark, sf):
    """Benjamini and Hochberg's rule at 0.05 over all pairs of languages and words."""
    tests = _language_tests(spark, sf).withColumn("q", F.round("p", 12))
    n = tests.where("q is not null").count()
    return models.step_up(tests, "q", alpha=0.05, total=F.lit(n)).select("i", "j", "d")


KNN = """v AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings),
nd AS (SELECT q.vec_id AS q, t.vec_id AS t, list_sum(list_transform(list_zip(q.b, t.b), lambda z: (z[1] <> z[2])::INT))::INT AS dist FROM v q JOIN v t ON q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS r FROM nd)"""


def _packed(spark, sf):
    """All rows, and as queries every row whose id 20 divides."""
    rows = examples(spark, sf).select(F.col("ex").alias("id"), nearest.packed(F.col("idx"), DIM).alias("words"))
    return rows, rows.where(F.col("id") % 20 == 0)


@query(f"WITH {KNN} SELECT q, t, dist FROM knn WHERE r <= 15")
def knn15(spark, sf):
    return nearest.nearest(*_packed(spark, sf), k=15).select("q", "t", "dist")


@query(f"WITH {KNN} SELECT q, t, dist, r FROM knn WHERE r <= 7")
def knn7_by_bands(spark, sf):
    """The same search through the index of bands; the exact way takes what it cannot settle."""
    return nearest.nearest_by_bands(*_packed(spark, sf), k=7, dim=DIM, bands=4).withColumn("r", F.col("r").cast("long"))


@query(f"WITH {KNN} SELECT a.q, a.t, (a.dist * s.dist * u.dist)::BIGINT AS k FROM knn a JOIN knn s ON s.q = a.q AND s.r = 7 JOIN knn u ON u.q = a.t AND u.r = 7")
def local_scale_kernel(spark, sf):
    """d^2 * s(a) * s(b) of all pairs of queries: for bits the squared distance is the Hamming distance, s its 7th least to any row."""
    return nearest.local_scale(*_packed(spark, sf))


@query("WITH u AS (SELECT page_id, string_split(regexp_replace(array_to_string(list_slice(string_split(url, '/'), -3, -1), '_'), '\\.html$', ''), '_') AS p FROM pages) SELECT page_id, p[1] AS dr, p[2] AS spk, p[3] AS sentence FROM u")
def id_parts(spark, sf):
    p = F.split(path_id(F.col("url"), "\\.html"), "_")
    return table(spark, sf, "pages").select("page_id", *[F.get(p, i).alias(n) for i, n in enumerate(("dr", "spk", "sentence"))])


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n]+'), lambda x: x <> '') AS f FROM documents) SELECT doc_id, f[1] AS first, f[2] AS second FROM w WHERE len(f) > 1")
def field_projection(spark, sf):
    """The first two fields of rows that have more than one."""
    fields = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n]+"), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", fields.alias("f")).where(F.size("f") > 1).select("doc_id", F.get("f", 0).alias("first"), F.get("f", 1).alias("second"))


@query("SELECT page_id, regexp_replace(url, '\\.html$', '.phn') AS path FROM pages")
def renamed_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "\\.html$", ".phn").alias("path"))


@query("SELECT a.r AS \"row\", a.page_id, b.doc_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS r FROM pages) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) b ON a.r = b.r")
def zipped_rows(spark, sf):
    return positions.zipped(table(spark, sf, "pages").select("page_id"), "page_id", table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT event_type AS label, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)")
def label_ids(spark, sf):
    return positions.numbered(table(spark, sf, "events").select(F.col("event_type").alias("label")).where("label is not null").distinct(), "label", name="id")


@query(f"WITH {TR} SELECT conv_id, turn, round((s + e - 159) / 160e0)::BIGINT AS t FROM tr")
def centred_frame(spark, sf):
    return signal.centred_frame(segments(spark, sf), length=160, hop=80).select("conv_id", "turn", "t")


@query(f"""WITH {WAVE}, sp AS (SELECT sig, n AS ord, n - 3 AS s, n + 4 AS e FROM wave WHERE n % 5 = 0), l AS (SELECT sig, count(*) AS len FROM wave GROUP BY 1),
a AS (SELECT sig, ord, len, unnest(range(7)) AS k, s FROM sp JOIN l USING (sig)), m AS (SELECT sig, ord, k, CASE WHEN s + k < 0 THEN -1 - s - k WHEN s + k >= len THEN 2 * len - 1 - s - k ELSE s + k END AS n FROM a)
SELECT sig, ord, k, x FROM m JOIN wave USING (sig, n)""")
def padded_segments(spark, sf):
    w = wave(spark, sf)
    spans = w.where(F.col("n") % 5 == 0).select("sig", F.col("n").alias("ord"), (F.col("n") - 3).alias("s"), (F.col("n") + 4).alias("e"))
    return signal.padded_segments(w.withColumnRenamed("n", "t"), spans).select("sig", "ord", "k", "x")


FOLD = WAVE + """, len AS (SELECT sig, count(*) AS len FROM wave GROUP BY 1 HAVING count(*) > 16), pl AS (SELECT sig, len, unnest(range(floor(5e-1 + len / 16e0 * 2)::BIGINT))::INT AS t FROM len),
pk AS (SELECT *, unnest(range(16))::INT AS k FROM pl), ix AS (SELECT sig, t, k, CASE WHEN t * 8 + k - 8 < 0 THEN 8 - t * 8 - k WHEN t * 8 + k - 8 > len - 1 THEN 2 * len - 2 - (t * 8 + k - 8) ELSE t * 8 + k - 8 END AS n FROM pk),
frame AS (SELECT sig, t, k, x FROM ix JOIN wave USING (sig, n)), fq AS (SELECT unnest(range(16))::INT AS f),
xf AS (SELECT sig, t, f, sum(x * cos(2 * pi() * f * k / 16)) * exp(-pow(least(f, 16 - f), 2) / 8e0) AS re, -sum(x * sin(2 * pi() * f * k / 16)) * exp(-pow(least(f, 16 - f), 2) / 8e0) AS im FROM frame CROSS JOIN fq GROUP BY 1, 2, 3),
yf AS (SELECT sig, t, f // 4 AS m, sum(re) AS re, sum(im) AS im FROM xf GROUP BY 1, 2, 3), qs AS (SELECT unnest(range(4))::INT AS q)"""


@query(f"WITH {FOLD} SELECT sig, t, q, round(sum(re * cos(pi() * m * q / 2) - im * sin(pi() * m * q / 2)) / 8, 5) + 0e0 AS re, round(sum(re * sin(pi() * m * q / 2) + im * cos(pi() * m * q / 2)) / 8, 5) + 0e0 AS im FROM yf CROSS JOIN qs GROUP BY 1, 2, 3")
def filter_and_fold(spark, sf):
    """Frames filtered by a Gaussian of the frequency and downsampled four times."""
    response = [math.exp(-(min(k, 16 - k) ** 2) / 8) for k in range(16)]
    out = signal.filtered_fold(signal.frames(wave(spark, sf)), response, power=2)
    return out.select("sig", "t", "q", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


CUBE = BITS + ", cube AS (SELECT ex, d // 16 AS t, d // 4 % 4 AS f, d % 4 AS e FROM ones)"


def _cube(spark, sf):
    return classify.ones(examples(spark, sf)).select("ex", F.floor(F.col("d") / 16).cast("int").alias("t"), (F.floor(F.col("d") / 4) % 4).cast("int").alias("f"), (F.col("d") % 4).alias("e"))


@query(f"WITH {CUBE}, o AS (SELECT i, j FROM (SELECT unnest(range(2))::INT AS i) CROSS JOIN (SELECT unnest(range(2))::INT AS j)) SELECT ex, (t - i)::INT AS t, (f - j)::INT AS f, ((i * 2 + j) * 4 + e)::INT AS d FROM cube CROSS JOIN o WHERE t - i BETWEEN 0 AND 2 AND f - j BETWEEN 0 AND 2")
def channel_patches(spark, sf):
    return patches.channel_patches(_cube(spark, sf), height=4, width=4, size=2, channels=4)


@query(f"WITH {CUBE} SELECT ex, t::INT AS t, f::INT AS f, e::INT AS e FROM cube WHERE e IN (0, 2) AND f < 3")
def channel_subset(spark, sf):
    return patches.channel_subset(_cube(spark, sf), channels=[0, 2], width=3)


CHANNELS = CUBE + """, o AS (SELECT i, j FROM (SELECT unnest(range(2))::INT AS i) CROSS JOIN (SELECT unnest(range(2))::INT AS j)),
patch AS (SELECT ex, t - i AS t, f - j AS f, (i * 2 + j) * 4 + e AS d FROM cube CROSS JOIN o WHERE t - i BETWEEN 0 AND 2 AND f - j BETWEEN 0 AND 2)"""
PC = CHANNELS + """,
part AS (SELECT k AS part, d, ((k * 7 + d * 5) % 11) / 5e0 - 1 AS w FROM (SELECT unnest(range(4))::INT AS k) CROSS JOIN (SELECT unnest(range(16))::INT AS d)), s AS (SELECT p.ex, p.t, p.f, part.part, round(sum(part.w) - part.part / 10e0, 9) AS s, count(*) AS n FROM patch p JOIN part ON part.d = p.d GROUP BY 1, 2, 3, 4),
m AS (SELECT *, max(s) OVER (PARTITION BY ex, t, f) AS best FROM s), code AS (SELECT ex, t, f, part FROM m WHERE s = best AND n >= 4 AND best >= 1), g AS (SELECT unnest(range(-1, 2))::INT AS i)"""


@query(f"WITH {PC} SELECT * FROM (SELECT DISTINCT ex, (t + a.i)::INT AS t, (f + b.i)::INT AS f, part FROM code CROSS JOIN g a CROSS JOIN g b) WHERE t BETWEEN 0 AND 2 AND f BETWEEN 0 AND 2")
def spread_parts(spark, sf):
    grid = spark.range(64).select(F.floor(F.col("id") / 16).cast("int").alias("part"), (F.col("id") % 16).cast("int").alias("d"))
    weights = grid.withColumn("w", ((F.col("part") * 7 + F.col("d") * 5) % 11) / 5.0 - 1)
    const = spark.range(4).select(F.col("id").cast("int").alias("part"), (-F.col("id") / 10.0).alias("b"))
    placed = patches.channel_patches(_cube(spark, sf), height=4, width=4, size=2, channels=4)
    codes = patches.part_codes(placed, weights, const, count_threshold=4, likelihood_threshold=1.0)
    return patches.spread(codes, radius=1, height=3, width=3, keep=("part",))


@query(f"""WITH {BITS}, c AS (SELECT ex, d // 8 AS t, d % 8 AS f, v FROM bits), o AS (SELECT i, j FROM (SELECT unnest(range(3))::INT AS i) CROSS JOIN (SELECT unnest(range(3))::INT AS j)),
n AS (SELECT ex, t - i AS t, f - j AS f, count(*) AS n FROM c CROSS JOIN o WHERE v > 0 AND t - i BETWEEN 0 AND 5 AND f - j BETWEEN 0 AND 5 GROUP BY 1, 2, 3),
m AS (SELECT a.ex, a.t, a.f FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.ex = a.ex AND abs(b.t - a.t) <= 1 AND abs(b.f - a.f) <= 1 AND b.n > a.n))
SELECT m.ex, m.t::INT AS t, m.f::INT AS f, (i * 3 + j)::INT AS d, round(c.v, 6) AS s FROM m CROSS JOIN o JOIN c ON c.ex = m.ex AND c.t = m.t + i AND c.f = m.f + j""")
def paired_patches(spark, sf):
    """For each local maximum of a patch's count of cells, the same patch of the values."""
    cell = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.posexplode("embedding").alias("d", "v")).select("ex", F.floor(F.col("d") / 8).cast("int").alias("t"), (F.col("d") % 8).alias("f"), F.col("v").cast("double").alias("s"))
    top = patches.local_maxima(patches.patches(cell.where("s > 0").select("ex", "t", "f"), height=8, width=8, size=3))
    return patches.value_patches(top, cell, size=3).withColumn("s", F.round("s", 6))


def _patch_examples(spark, sf):
    placed = patches.channel_patches(_cube(spark, sf), height=4, width=4, size=2, channels=4)
    return placed.groupBy((F.col("ex") * 9 + F.col("t") * 3 + F.col("f")).alias("ex")).agg(F.array_sort(F.collect_list("d")).alias("idx"))


#: The mixture's SQL over patches in place of the examples.
LEARNT = "WITH " + CHANNELS.replace("ones", "cells") + ", ones AS (SELECT (ex * 9 + t * 3 + f)::BIGINT AS ex, d FROM patch), pe AS (SELECT DISTINCT ex AS vec_id FROM ones)" + _em_sql(2).removeprefix("WITH " + BITS).replace("FROM embeddings", "FROM pe")


@query(LEARNT.replace(" SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a2", " SELECT comp::INT AS comp, round(sum(a), 3) AS mass FROM a2 GROUP BY 1 HAVING sum(a) > 30"))
def learnt_parts(spark, sf):
    """A mixture over all patches; components with more responsibility than 30 are parts."""
    soft, _ = iterate.em(_patch_examples(spark, sf), 16, 3, rounds=2)
    return patches.kept_parts(soft, least=30.0).withColumn("mass", F.round("mass", 3))


@query(f"WITH {BITS} SELECT ex, d, round(v * exp(v), 9) AS v FROM bits")
def exponential_weight(spark, sf):
    v = F.col("x").cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.posexplode("embedding").alias("d", "x")).select("ex", "d", F.round(v * F.exp(v), 9).alias("v"))


@query(f"WITH {SC}, riv AS (SELECT ex, max(score) FILTER (WHERE cls = truth) AS own, max(score) FILTER (WHERE cls <> truth) AS rival FROM sc GROUP BY 1), h AS (SELECT round(1 + rival - own, 6) AS hinge, row_number() OVER (ORDER BY round(1 + rival - own, 6)) AS r, count(*) OVER () AS n FROM riv) SELECT round(1 / hinge, 9) AS k FROM h WHERE r = n // 2 + 1")
def self_pace_rate(spark, sf):
    median = classify.upper_median(classify.rivals(scored(spark, sf)), "hinge")
    return median.select(F.round(F.try_divide(F.lit(1.0), "median"), 9).alias("k"))


@query("SELECT role AS label, (length(text) // 50)::BIGINT AS bin, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2")
def length_histogram(spark, sf):
    return table(spark, sf, "conversations").where("text is not null").groupBy(F.col("role").alias("label"), F.floor(F.length("text") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS symbol, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY n DESC, symbol LIMIT 3")
def top_symbols(spark, sf):
    stats = table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return stats.orderBy(F.desc("n"), "symbol").limit(3)


@query("WITH e AS (SELECT user_id AS sig, event_type AS det, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS n, value AS x FROM events), t AS (SELECT sig, n, max(x) AS top FROM e GROUP BY 1, 2), w AS (SELECT sig, n, max(top) OVER (PARTITION BY sig ORDER BY n RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM t) SELECT e.sig, e.det, e.n, e.x FROM e JOIN w USING (sig, n) WHERE e.x >= w.top AND e.x > 50")
def detector_peaks(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sig"), F.col("event_type").alias("det"), n.cast("long").alias("n"), F.col("value").alias("x"))
    return signal.detector_peaks(rows, radius=1, threshold=50.0)


@query(f"WITH {WAVE}, g AS (SELECT round(x, 1) AS score, sum((n % 3 = 0)::INT) AS h, sum((n % 3 <> 0)::INT) AS a FROM wave GROUP BY 1) SELECT score, round(sum(h) OVER (ORDER BY score DESC) / sum(h) OVER ()::DOUBLE, 9) AS rate, round(sum(a) OVER (ORDER BY score DESC) / 24e0, 9) AS alarms_per_hour FROM g")
def roc_rates(spark, sf):
    rows = wave(spark, sf).select(F.round("x", 1).alias("score"), (F.col("n") % 3 == 0).alias("hit"))
    return signal.roc_rates(signal.roc(rows), hours=24.0).select("score", F.round("rate", 9).alias("rate"), F.round("alarms_per_hour", 9).alias("alarms_per_hour"))


@query(f"WITH {TMPL}, w AS (SELECT d, w FROM lo WHERE cls = 0), y AS (SELECT vec_id AS ex, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings), z AS (SELECT y.ex, y.y, coalesce(sum(w.w), 0) AS z FROM y LEFT JOIN ones o ON o.ex = y.ex LEFT JOIN w ON w.d = o.d GROUP BY 1, 2), g AS (SELECT o.d, sum(-z.y)::DOUBLE AS g FROM z JOIN ones o ON o.ex = z.ex WHERE round(-z.y * z.z, 9) > -1 + 1e-6 GROUP BY 1) SELECT w.d, round(w.w / 10 + coalesce(g.g, 0), 6) AS w FROM w LEFT JOIN g ON g.d = w.d")
def prepared_subgradient(spark, sf):
    """z = Xw and w times lambda first, then the error set's sub-gradient is added."""
    w = classify.log_odds(model(spark, sf)).where("cls = 0").select("d", "w")
    rows = examples(spark, sf).select("ex", "idx", F.when(F.col("cls") < 5, 1).otherwise(-1).alias("y"))
    return detect.prepared_subgradient(rows, w, shrink=0.1, eps=1e-6).withColumn("w", F.round("w", 6))


@query("SELECT vec_id AS ex, CASE WHEN label IN (0, 1) THEN 0 ELSE 1 END AS y FROM embeddings WHERE label IN (0, 1, 5, 6, 7)")
def two_class_sets(spark, sf):
    return detect.two_class_sets(examples(spark, sf), [0, 1], [5, 6, 7]).select("ex", "y")

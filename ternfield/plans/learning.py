"""Queries over ``operators.learn`` and the further forms of EM."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ternfield.functions.features import set_bits, soft_bits
from ternfield.operators import classify, grid, iterate, kernel, learn, mixtures, models
from ternfield.plans.catalog import ASSIGN, BASE, BITS, DIM, ORACLE, SCALE, TMPL, examples, query
from ternfield.sources.scratch import written
from ternfield.sources.tables import table

CLASSES = list(range(10))


def _weights(spark, w, row="cls"):
    return spark.createDataFrame([(j, d, round(float(x), 9) + 0.0) for j, r in enumerate(w) for d, x in enumerate(r)], f"{row} int, d int, w double")


@query(None)
def multiclass_2step(spark, sf):
    return _weights(spark, learn.multiclass(examples(spark, sf), DIM, CLASSES, steps=2, rate=2.0))


def _multiclass_sql(steps: int) -> str:
    parts = [BITS, "c AS (SELECT unnest(range(10))::INT AS cls)", "w0 AS (SELECT cls, unnest(range(64))::INT AS d, 0e0 AS w FROM c)"]
    for t in range(steps):
        parts += [
            f"z{t} AS MATERIALIZED (SELECT e.vec_id AS ex, e.label AS truth, c.cls, round(coalesce(s, 0), 12) AS z FROM embeddings e CROSS JOIN c LEFT JOIN (SELECT o.ex, w.cls, sum(w.w) AS s FROM ones o JOIN w{t} w ON w.d = o.d GROUP BY 1, 2) q ON q.ex = e.vec_id AND q.cls = c.cls)",
            f"r{t} AS MATERIALIZED (SELECT ex, truth, max(z) FILTER (WHERE cls = truth) AS own, max(z) FILTER (WHERE cls <> truth) AS off FROM z{t} GROUP BY 1, 2)",
            f"o{t} AS MATERIALIZED (SELECT r.ex, r.truth, min(z.cls) AS rival FROM r{t} r JOIN z{t} z ON z.ex = r.ex AND z.cls <> r.truth AND z.z = r.off WHERE r.off - r.own > -1 GROUP BY 1, 2)",
            f"g{t} AS MATERIALIZED (SELECT cls, d, sum(p) AS g FROM (SELECT v.truth AS cls, o.d, 1 AS p FROM o{t} v JOIN ones o ON o.ex = v.ex UNION ALL SELECT v.rival, o.d, -1 FROM o{t} v JOIN ones o ON o.ex = v.ex) GROUP BY 1, 2)",
            f"u{t} AS MATERIALIZED (SELECT w.cls, w.d, (1 - 1e0 / {t + 1}) * w.w + 1e0 / (2 * {t + 1}) / (SELECT count(*) FROM embeddings) * coalesce(g.g, 0) AS w FROM w{t} w LEFT JOIN g{t} g ON g.cls = w.cls AND g.d = w.d)",
            f"w{t + 1} AS MATERIALIZED (SELECT cls, d, w * least(1, 1 / (sqrt(2e0) * sqrt(sum(w * w) OVER ()))) AS w FROM u{t})",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT cls, d, round(w, 9) + 0e0 AS w FROM w{steps}"


ORACLE["multiclass_2step"] = _multiclass_sql(2)


@query(None)
def all_pairs_2step(spark, sf):
    return _weights(spark, learn.all_pairs(examples(spark, sf), DIM, CLASSES, steps=2, rate=2.0), "pair")


def _all_pairs_sql(steps: int) -> str:
    parts = [BITS, "pr AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS pair, i, j FROM (SELECT unnest(range(10))::INT AS i) CROSS JOIN (SELECT unnest(range(10))::INT AS j) WHERE i < j)", "y AS (SELECT vec_id AS ex, pair, CASE WHEN label = i THEN 1 ELSE -1 END AS y FROM embeddings JOIN pr ON label = i OR label = j)", "n AS (SELECT pair, count(*) AS n FROM y GROUP BY 1)", "w0 AS (SELECT pair, unnest(range(64))::INT AS d, 0e0 AS w FROM pr)"]
    for t in range(steps):
        parts += [
            f"v{t} AS MATERIALIZED (SELECT y.* FROM y LEFT JOIN (SELECT y.ex, y.pair, sum(w.w) AS s FROM y JOIN ones o ON o.ex = y.ex JOIN w{t} w ON w.d = o.d AND w.pair = y.pair GROUP BY 1, 2) s USING (ex, pair) WHERE y.y * round(coalesce(s.s, 0), 12) < 1)",
            f"w{t + 1} AS MATERIALIZED (SELECT w.pair, w.d, (1 - 1e0 / {t + 1}) * w.w + 1e0 / (2 * {t + 1}) / n * coalesce(g.g, 0) AS w FROM w{t} w JOIN n ON n.pair = w.pair LEFT JOIN (SELECT v.pair, o.d, sum(v.y) AS g FROM v{t} v JOIN ones o ON o.ex = v.ex GROUP BY 1, 2) g ON g.pair = w.pair AND g.d = w.d)",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT pair, d, round(w, 9) + 0e0 AS w FROM w{steps}"


ORACLE["all_pairs_2step"] = _all_pairs_sql(2)

_TRAINED = _all_pairs_sql(2).rpartition(" SELECT pair, d,")[0] + """, tp AS MATERIALIZED (SELECT pair, d, round(w, 9) AS w FROM w2),
ts AS (SELECT e.vec_id AS ex, e.label AS truth, pr.i, pr.j, round(coalesce(s.s, 0), 9) AS score FROM embeddings e CROSS JOIN pr LEFT JOIN (SELECT o.ex, tp.pair, sum(tp.w) AS s FROM ones o JOIN tp ON tp.d = o.d GROUP BY 1, 2) s ON s.ex = e.vec_id AND s.pair = pr.pair),
tv AS (SELECT ex, truth, cls, sum(v) AS v FROM (SELECT ex, truth, i AS cls, (score > 0)::INT AS v FROM ts UNION ALL SELECT ex, truth, j, (score < 0)::INT FROM ts) GROUP BY 1, 2, 3),
tr AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY v DESC, cls{ties}) AS r FROM tv) SELECT ex, truth, cls AS guess FROM tr WHERE r = 1"""


def _trained_votes(spark, sf, **ties):
    """Hinge fits of all pairs, each trained apart, vote on every example; as there, the models have no bias."""
    pairs = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate((i, j) for i in CLASSES for j in CLASSES if i < j)], "pair int, i int, j int")
    weights = all_pairs_2step(spark, sf).join(pairs, "pair").select("i", "j", "d", "w")
    return models.pair_guesses(examples(spark, sf), models.pair_row(weights, pairs.select("i", "j", F.lit(0.0).alias("b"))), **ties)


@query(_TRAINED.replace("{ties}", ""))
def trained_vote_low(spark, sf):
    return _trained_votes(spark, sf)


@query(_TRAINED.replace("{ties}", " DESC"))
def trained_vote_high(spark, sf):
    return _trained_votes(spark, sf, high_ties=True)


@query(_all_pairs_sql(2).rpartition(" SELECT pair, d,")[0] + " SELECT (dense_rank() OVER (ORDER BY pr.j, pr.i) - 1)::INT AS matrix_row, pr.j AS neg, pr.i AS pos, d, round(w, 9) + 0e0 AS w FROM w2 JOIN pr USING (pair)")
def pair_matrix(spark, sf):
    """The trained pair models as rows of one matrix, in the order of (neg, pos)."""
    pairs = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate((i, j) for i in CLASSES for j in CLASSES if i < j)], "pair int, i int, j int")
    weights = all_pairs_2step(spark, sf).join(pairs, "pair").select("i", "j", "d", "w")
    matrix = models.pair_matrix(weights, pairs.select("i", "j", F.lit(0.0).alias("b")), DIM)
    return matrix.select(F.col("row").alias("matrix_row"), "neg", "pos", F.posexplode("w").alias("d", "w"))


#: Form of the learner -> its options; two weight rows a class where components are learnt.
FORMS = {
    "ramp": {"loss": "ramp"},
    "self_paced": {"loss": "self_paced", "k": 0.4},
    "smoothed": {"loss": "smoothed", "gamma": 0.5, "beta": 0.5},
    "averaged": {"average": 2.0},
    "differences": {"differences": True},
    "components": {"components": 2},
    "fixed_point": {"base": BASE},
    "biased": {"bias": "add"},
}


#: Steps of each form, the first one's number, and the forms' step rate.
FORM_STEPS, FORM_START, FORM_RATE = 3, 4, 1.0


def _form_sql(name: str, options: dict) -> list[str]:
    """The unrolled steps of one form, as steps of SQL: {name}_m{FORM_STEPS} (r, d, w) holds the weights."""
    k, n, x = options.get("components", 1), len(CLASSES) * options.get("components", 1), "soft" if "base" in options else "hard"
    bias = " + 1e-1" if "bias" in options else ""
    use = {"ramp": "gap > -1 AND gap < 1", "self_paced": f"gap > -1 AND {options.get('k')}::DOUBLE * (1 + gap) < 1"}.get(options.get("loss"), "gap > -1")
    if options.get("loss") == "smoothed":
        temper = f"CASE WHEN mine THEN {options['beta']}::DOUBLE ELSE {options['gamma']}::DOUBLE END"
        share = f"exp((z - top) / ({temper})) / sum(exp((z - top) / ({temper}))) OVER (PARTITION BY ex, mine)"
    else:
        share = "(r = best)::INT"
    parts = [f"{name}_w0 AS MATERIALIZED (SELECT (j * {len(CLASSES)} + cls)::INT AS r, d, w * (1 + j * 1e-1) AS w FROM lo CROSS JOIN (SELECT unnest(range({k})) AS j))", f"{name}_m0 AS (SELECT * FROM {name}_w0)"]
    for i in range(FORM_STEPS):
        t, at = FORM_START + i, lambda c, i=i: f"{name}_{c}{i}"
        eta = f"(1e0 / ({FORM_RATE}::DOUBLE * {t + 1}))"
        if options.get("differences"):
            kept, scale = f"w.w - ({n} * w.w - sum(w.w) OVER (PARTITION BY w.d)) / {t + 1 + n}", f"SELECT {n} * (SELECT sum(w * w) FROM {at('u')}) - (SELECT sum(s * s) FROM (SELECT sum(w) AS s FROM {at('u')} GROUP BY d)) AS far"
        else:
            kept, scale = f"(1 - {eta} * {FORM_RATE}::DOUBLE) * w.w", f"SELECT sum(w * w) AS far FROM {at('u')}"
        e = options.get("average")
        part = f"({e + 1}::DOUBLE / {i + e + 1}::DOUBLE)" if e is not None else "1e0"
        parts += [
            f"{at('z')} AS MATERIALIZED (SELECT e.vec_id AS ex, e.label AS truth, g.r, round(coalesce(s.s, 0){bias}, 12) AS z FROM embeddings e CROSS JOIN (SELECT DISTINCT r FROM {at('w')}) g LEFT JOIN (SELECT o.ex, w.r, sum(w.w * o.x) AS s FROM {x} o JOIN {at('w')} w USING (d) GROUP BY 1, 2) s ON s.ex = e.vec_id AND s.r = g.r)",
            f"{at('q')} AS MATERIALIZED (SELECT *, first_value(r) OVER (PARTITION BY ex, mine ORDER BY z DESC, r) AS best, max(z) OVER (PARTITION BY ex, mine) AS top FROM (SELECT *, r % {len(CLASSES)} = truth AS mine FROM {at('z')}))",
            f"{at('y')} AS (SELECT ex FROM (SELECT ex, max(top) FILTER (WHERE NOT mine) - max(top) FILTER (WHERE mine) AS gap FROM {at('q')} GROUP BY 1) WHERE {use})",
            f"{at('p')} AS MATERIALIZED (SELECT ex, r, (CASE WHEN mine THEN 1 ELSE -1 END) * {share} AS pull FROM {at('q')} SEMI JOIN {at('y')} USING (ex))",
            f"{at('g')} AS MATERIALIZED (SELECT p.r, o.d, sum(p.pull * o.x) AS g FROM {at('p')} p JOIN {x} o USING (ex) GROUP BY 1, 2)",
            f"{at('u')} AS MATERIALIZED (SELECT w.r, w.d, {kept} + {eta} / (SELECT count(*) FROM embeddings) * coalesce(g.g, 0) AS w FROM {at('w')} w LEFT JOIN {at('g')} g USING (r, d))",
            f"{name}_w{i + 1} AS MATERIALIZED (SELECT r, d, w * least(1, 1 / sqrt({FORM_RATE}::DOUBLE * far)) AS w FROM {at('u')} CROSS JOIN ({scale}))",
            f"{name}_m{i + 1} AS MATERIALIZED (SELECT r, d, (1 - {part}) * m.w + {part} * w.w AS w FROM {at('m')} m JOIN {name}_w{i + 1} w USING (r, d))",
        ]
    return parts


_FORMS_SQL = "WITH " + ",\n".join([TMPL, "hard AS (SELECT ex, d, 1e0 AS x FROM ones)", f"soft AS (SELECT ex, d, least({BASE}, floor(greatest(v, 0) * {SCALE} * {BASE})) / {BASE}::DOUBLE AS x FROM bits WHERE v > 0)", *(p for name, options in FORMS.items() for p in _form_sql(name, options))])


def _form_fits(spark, sf):
    """The examples, and (form, options, weights) after three steps from the templates' log-odds."""
    lo = {(r["cls"], r["d"]): r["w"] for r in classify.log_odds(classify.templates(examples(spark, sf), DIM)).collect()}
    warm = np.array([[lo[c, d] for d in range(DIM)] for c in CLASSES])
    bits, cells = set_bits(F.col("embedding")).alias("idx"), soft_bits(F.col("embedding"), BASE, SCALE).alias("cells")
    both = written(table(spark, sf, "embeddings").select(F.col("label").alias("cls"), bits, cells), "forms").withColumn("add", F.array_repeat(F.lit(0.1), len(CLASSES)))
    fits = []
    for name, options in FORMS.items():
        k = options.get("components", 1)
        of, start = CLASSES * k, np.concatenate([warm * (1 + 0.1 * j) for j in range(k)])
        given = {n: v for n, v in options.items() if n != "components"}
        fits.append((name, options, learn.multiclass(both, DIM, of, steps=FORM_STEPS, rate=FORM_RATE, start=start, start_step=FORM_START, **given)))
    return both, fits


@query(_FORMS_SQL + " " + " UNION ALL ".join(f"SELECT '{name}' AS form, r AS weight_row, d, round(w, 6) + 0e0 AS w FROM {name}_m{FORM_STEPS}" for name in FORMS))
def learner_weights(spark, sf):
    """The weights of every form of the learner."""
    fits = _form_fits(spark, sf)[1]
    cells = [(name, j, d, round(float(x), 6) + 0.0) for name, _, w in fits for j, r in enumerate(w) for d, x in enumerate(r)]
    return spark.createDataFrame(cells, "form string, weight_row int, d int, w double")


def _form_accuracy_sql(name: str, options: dict) -> str:
    x = "soft" if "base" in options else "hard"
    z = f"SELECT e.vec_id AS ex, e.label AS truth, g.r, round(coalesce(s.s, 0), 12) AS z FROM embeddings e CROSS JOIN (SELECT DISTINCT r FROM {name}_m{FORM_STEPS}) g LEFT JOIN (SELECT o.ex, w.r, sum(w.w * o.x) AS s FROM {x} o JOIN {name}_m{FORM_STEPS} w USING (d) GROUP BY 1, 2) s ON s.ex = e.vec_id AND s.r = g.r"
    return f"SELECT '{name}' AS form, round(avg((best % {len(CLASSES)} = truth)::INT), 9) AS accuracy FROM (SELECT truth, first_value(r) OVER (PARTITION BY ex ORDER BY z DESC, r) AS best, row_number() OVER (PARTITION BY ex ORDER BY z DESC, r) AS rank FROM ({z})) WHERE rank = 1"


@query(_FORMS_SQL + " " + " UNION ALL ".join(_form_accuracy_sql(name, options) for name, options in FORMS.items()))
def learner_forms(spark, sf):
    """(form, accuracy) on all examples after three steps from the templates' log-odds."""
    both, fits = _form_fits(spark, sf)
    out = []
    for name, options, w in fits:
        best = F.array_max(F.transform("z", lambda x, i: F.struct(x.alias("z"), (-i).alias("i"))))["i"]
        guess = learn.margins(both, w, base=options.get("base")).select("cls", (-best % len(CLASSES)).alias("guess"))
        out.append((name, guess.agg(F.round(F.avg((F.col("cls") == F.col("guess")).cast("double")), 9)).first()[0]))
    return spark.createDataFrame(out, "form string, accuracy double")


@query("SELECT e.vec_id AS ex, m.vec_id AS mark, round(exp(-sqrt(list_sum(list_transform(list_zip(e.embedding, m.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))), 6) AS k FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 64) m")
def kernel_features(spark, sf):
    """Against 64 landmarks."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = learn.kernel_features(v.withColumnRenamed("vec_id", "ex"), v.where("vec_id < 64").withColumnRenamed("vec_id", "mark"))
    return out.select("ex", F.posexplode("k").alias("mark", "k")).select("ex", F.col("mark").cast("long").alias("mark"), F.round("k", 6).alias("k"))


PENALTIES = [1.0, 0.1, 0.01]


def _grid_sql(rows: str, classes: list[int], passes: int) -> str:
    """Unrolled passes over ``rows`` (ex, cls, dev) for all classes and penalties."""
    guess = "cls = first_cls" if len(classes) > 1 else f"(z > 0) = (cls = {classes[0]})"
    parts = [BITS, f"r AS MATERIALIZED ({rows})", "n AS (SELECT count(*) AS n FROM r WHERE NOT dev)", f"c AS (SELECT unnest({classes})::INT AS c)", f"pn AS (SELECT unnest({PENALTIES})::DOUBLE AS pen)", "w0 AS (SELECT pen, c, unnest(range(64))::INT AS d, 0e0 AS w FROM pn, c)"]
    for t in range(passes + 1):
        parts += [
            f"z{t} AS MATERIALIZED (SELECT r.ex, r.cls, r.dev, pn.pen, c.c, CASE WHEN r.cls = c.c THEN 1 ELSE -1 END AS y, round(coalesce(s.s, 0), 12) AS z FROM r CROSS JOIN pn CROSS JOIN c LEFT JOIN (SELECT o.ex, w.pen, w.c, sum(w.w) AS s FROM ones o JOIN w{t} w USING (d) GROUP BY 1, 2, 3) s ON s.ex = r.ex AND s.pen = pn.pen AND s.c = c.c)",
            f"q{t} AS (SELECT {t} AS pass, pen, avg(({guess})::INT) AS accuracy FROM (SELECT *, first_value(c) OVER (PARTITION BY ex, pen ORDER BY z DESC, c) AS first_cls FROM z{t} WHERE dev) WHERE c = {classes[0]} GROUP BY 2)",
            f"g{t} AS MATERIALIZED (SELECT z.pen, z.c, o.d, sum(z.y) AS g FROM z{t} z JOIN ones o USING (ex) WHERE NOT z.dev AND z.y * z.z < 1 GROUP BY 1, 2, 3)",
            f"w{t + 1} AS MATERIALIZED (SELECT w.pen, w.c, w.d, (1 - 1e0 / {t + 1}) * w.w + w.pen * n.n / {t + 1} / n.n * coalesce(g.g, 0) AS w FROM n CROSS JOIN w{t} w LEFT JOIN g{t} g ON g.pen = w.pen AND g.c = w.c AND g.d = w.d)",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM q{t}" for t in range(1, passes + 1))
    return "WITH " + ",\n".join(parts) + f" SELECT pass::INT AS pass, pen AS penalty, round(accuracy, 9) AS accuracy FROM ({every})"


def _rounded(df):
    return df.withColumn("accuracy", F.round("accuracy", 9))


@query(_grid_sql("SELECT vec_id AS ex, CASE WHEN label < 5 THEN 1 ELSE 0 END AS cls, vec_id % 5 = 4 AS dev FROM embeddings", [1], 3))
def linear_svm_grid(spark, sf):
    """Two classes: accuracy on held rows by pass and penalty."""
    rows = examples(spark, sf).select((F.col("cls") < 5).cast("int").alias("cls"), "idx", (F.col("ex") % 5 == 4).alias("dev"))
    return _rounded(grid.linear_grid(rows, DIM, [1], PENALTIES, passes=3)[0])


@query(_grid_sql("SELECT vec_id AS ex, label AS cls, vec_id % 5 = 4 AS dev FROM embeddings", CLASSES, 3))
def one_vs_rest_grid(spark, sf):
    """Ten classes, each against the rest: accuracy on held rows by pass and penalty, thirty models a pass."""
    rows = examples(spark, sf).select("cls", "idx", (F.col("ex") % 5 == 4).alias("dev"))
    return _rounded(grid.linear_grid(rows, DIM, CLASSES, PENALTIES, passes=3)[0])


#: Kernel machines: (gamma, C), steps and rows a step.
MACHINES, STEPS, BATCH = [(1.0, 1.0), (1.0, 0.1), (0.1, 1.0), (0.1, 0.1)], 3, 32


def _machine_sql() -> str:
    """Decision values of all rows after the unrolled steps; training rows are those of remainders 0 to 2."""
    far = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    models = ", ".join(f"({g}, {c})" for g, c in MACHINES)
    parts = [
        "x AS MATERIALIZED (SELECT vec_id AS ex, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, embedding::DOUBLE[] AS v, vec_id % 5 AS part FROM embeddings)",
        "n AS (SELECT count(*) AS n FROM x WHERE part < 3)",
        f"mo AS (SELECT g::DOUBLE AS gamma, c::DOUBLE AS pen FROM (VALUES {models}) t(g, c))",
        f"tk AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY ex % 65521 * 40503 % 65521, ex) - 1) // {BATCH} AS step FROM x WHERE part < 3 QUALIFY row_number() OVER (ORDER BY ex % 65521 * 40503 % 65521, ex) <= {STEPS * BATCH})",
        f"far AS MATERIALIZED (SELECT a.ex, b.ex AS sup, b.y AS sy, b.step, {far} AS far FROM x a CROSS JOIN tk b)",
        "u0 AS (SELECT ex, gamma, pen FROM tk, mo WHERE step = 0)",
    ]
    value = lambda t: f"SELECT f.ex, u.gamma, u.pen, sum(f.sy * exp(-u.gamma * f.far)) * u.pen * min(n.n) / ({t} * {BATCH}) AS f FROM far f JOIN u{t - 1} u ON u.ex = f.sup CROSS JOIN n"
    for t in range(1, STEPS):
        parts.append(f"u{t} AS MATERIALIZED (SELECT * FROM u{t - 1} UNION ALL SELECT tk.ex, mo.gamma, mo.pen FROM tk CROSS JOIN mo LEFT JOIN ({value(t)} GROUP BY f.ex, u.gamma, u.pen) q ON q.ex = tk.ex AND q.gamma = mo.gamma AND q.pen = mo.pen WHERE tk.step = {t} AND tk.y * coalesce(q.f, 0) < 1)")
    parts.append(f"fin AS MATERIALIZED ({value(STEPS)} GROUP BY f.ex, u.gamma, u.pen)")
    return "WITH " + ",\n".join(parts)


def _machine_rows(spark, sf, keep):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(keep(F.col("ex") % 5))


@query(_machine_sql() + " SELECT ex, gamma, pen AS penalty, round(f, 6) AS f FROM fin")
def kernel_machine(spark, sf):
    """Decision values of every row under four radial kernel machines, fitted on rows of remainders 0 to 2."""
    machines = kernel.fit(_machine_rows(spark, sf, lambda r: r < 3), MACHINES, steps=STEPS, batch=BATCH)
    named = F.array(*[F.struct(F.lit(g).alias("gamma"), F.lit(c).alias("penalty")) for g, c in MACHINES])
    out = kernel.decide(_machine_rows(spark, sf, lambda r: F.lit(True)), machines).select("ex", F.posexplode("f").alias("j", "f"))
    return out.withColumn("m", F.get(named, F.col("j"))).select("ex", "m.gamma", "m.penalty", F.round("f", 6).alias("f"))


@query(_machine_sql() + " SELECT gamma, pen AS penalty, round(avg(((f > 0) = (y > 0))::INT), 9) AS accuracy FROM fin JOIN x USING (ex) WHERE part = 3 GROUP BY 1, 2")
def kernel_svm_grid(spark, sf):
    """Accuracy of the same machines on the rows of remainder 3."""
    machines = kernel.fit(_machine_rows(spark, sf, lambda r: r < 3), MACHINES, steps=STEPS, batch=BATCH)
    return _rounded(kernel.accuracy(_machine_rows(spark, sf, lambda r: r == 3), machines))


WM = BITS + """, a AS (SELECT vec_id AS ex, vec_id % 3 AS comp, 1e0 / (1 + vec_id % 4) AS a FROM embeddings), t AS (SELECT comp, sum(a) AS t FROM a GROUP BY 1)"""


@query(f"WITH {WM} SELECT a.comp::INT AS comp, o.d, round(greatest(least(sum(a.a) / min(t), 99e-2), 1e-2), 9) AS p FROM a JOIN ones o USING (ex) JOIN t ON t.comp = a.comp GROUP BY 1, 2")
def weighted_m_step(spark, sf):
    """Means of three components when examples have weights 1 / (1 + ex mod 4)."""
    u = 1.0 / (1 + F.col("ex") % 4)
    soft = examples(spark, sf).withColumn("a", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda c: F.when(F.col("ex") % 3 == c, u).otherwise(0.0)))
    means, _ = iterate.m_step(soft, DIM, 3)
    return spark.createDataFrame([(c, d, round(float(p), 9)) for c, r in enumerate(means) for d, p in enumerate(r)], "comp int, d int, p double")


@query(ORACLE["em_2iter"].replace("SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a2", ", un AS (SELECT vec_id AS ex, unnest(range(64))::INT AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT comp::INT AS comp, d, round(sum(a * x) / sum(a), 6) + 0e0 AS mean FROM a2 JOIN un USING (ex) GROUP BY 1, 2"))
def cluster_means(spark, sf):
    """Means of the raw vectors in each soft cluster found on their bits."""
    soft, _ = iterate.em(examples(spark, sf), DIM, 3, rounds=2)
    raw = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), "embedding")
    return iterate.cluster_means(soft, raw, "embedding").select("comp", "d", (F.round("mean", 6) + 0.0).alias("mean"))


@query(None)
def em_pruned(spark, sf):
    """Masses of the components that stay when those below 16 % of the examples go."""
    rows = examples(spark, sf)
    soft, k = iterate.pruned(rows, DIM, 6, least=0.16 * rows.count(), rounds=3)
    return soft.select(F.posexplode("a").alias("comp", "a")).groupBy("comp").agg(F.round(F.sum("a"), 3).alias("mass"))


FIXED = ORACLE["em_2iter"].replace("ones AS (SELECT ex, cls, d FROM bits WHERE v > 0)", "ones AS (SELECT ex, cls, d, least(255, floor(greatest(v, 0) * 4 * 255)) / 255e0 AS x FROM bits WHERE v > 0)")


@query(FIXED.replace("sum(a.a) / min(t.t)", "sum(a.a * o.x) / min(t.t)").replace("sum(ln(p.p) - ln(1 - p.p))", "sum(o.x * (ln(p.p) - ln(1 - p.p)))"))
def em_fixed_point(spark, sf):
    """Responsibilities of three components on fixed-point values."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), soft_bits(F.col("embedding"), BASE, SCALE).alias("cells"))
    soft, _ = iterate.em(rows, DIM, 3, rounds=2, base=BASE)
    return soft.select("ex", F.posexplode("a").alias("comp", "a")).select("ex", "comp", F.round("a", 6).alias("a"))


def _node_em(rounds: int, members: str, start: str = "mem.ex % mem.k") -> list[str]:
    """EM in every node of ``members`` (ex, node, k, u), as steps of SQL; a0, a1, … hold responsibilities, l0, l1, … likelihoods."""
    parts = [f"mem AS MATERIALIZED ({members})", "g AS MATERIALIZED (SELECT node, unnest(range(k))::INT AS comp FROM (SELECT DISTINCT node, k FROM mem))", "gd AS (SELECT node, comp, unnest(range(64))::INT AS d FROM g)", f"a0 AS MATERIALIZED (SELECT mem.ex, mem.node, mem.u, g.comp, ({start} = g.comp)::INT::DOUBLE AS a FROM mem JOIN g USING (node))"]
    for r in range(rounds):
        parts += [
            f"t{r} AS MATERIALIZED (SELECT node, comp, sum(a * u) AS t FROM a{r} GROUP BY 1, 2)",
            f"s{r} AS MATERIALIZED (SELECT a.node, a.comp, o.d, sum(a.a * a.u) AS s FROM a{r} a JOIN ones o USING (ex) GROUP BY 1, 2, 3)",
            f"p{r} AS MATERIALIZED (SELECT node, comp, d, greatest(least(coalesce(s, 0) / greatest(t, 1e-300), 99e-2), 1e-2) AS p FROM gd JOIN t{r} USING (node, comp) LEFT JOIN s{r} USING (node, comp, d))",
            f"b{r} AS MATERIALIZED (SELECT node, comp, c + ln(greatest(t / sum(t) OVER (PARTITION BY node), 1e-300)) AS b FROM (SELECT node, comp, sum(ln(1 - p)) AS c FROM p{r} GROUP BY 1, 2) JOIN t{r} USING (node, comp))",
            f"z{r} AS MATERIALIZED (SELECT mem.ex, mem.node, mem.u, b.comp, b.b + coalesce(q.s, 0) AS z FROM mem JOIN b{r} b USING (node) LEFT JOIN (SELECT mem.ex, p.node, p.comp, sum(ln(p.p) - ln(1 - p.p)) AS s FROM mem JOIN ones o USING (ex) JOIN p{r} p ON p.node = mem.node AND p.d = o.d GROUP BY 1, 2, 3) q ON q.ex = mem.ex AND q.node = mem.node AND q.comp = b.comp)",
            f"l{r} AS MATERIALIZED (SELECT ex, node, x + ln(sum(exp(z - x))) AS l FROM (SELECT *, max(z) OVER (PARTITION BY ex, node) AS x FROM z{r}) GROUP BY ex, node, x)",
            f"a{r + 1} AS MATERIALIZED (SELECT z.ex, z.node, z.u, z.comp, exp(z.z - l.l) AS a FROM z{r} z JOIN l{r} l USING (ex, node))",
        ]
    return parts


@query(f"WITH {ASSIGN}, uu AS (SELECT ex, coalesce(sum(a) FILTER (WHERE cls = truth), 0) AS u FROM asg GROUP BY 1), " + ",\n".join(_node_em(2, "SELECT vec_id AS ex, label AS node, 2 AS k, uu.u FROM embeddings JOIN uu ON uu.ex = vec_id")) + " SELECT node AS cls, round(sum(l), 3) AS loglik FROM l1 GROUP BY 1")
def em_by_class(spark, sf):
    """Log likelihood of two components inside each class, weighted by the true class's share of the posterior."""
    scored = classify.scores(examples(spark, sf), classify.templates(examples(spark, sf), DIM))
    own = F.sum(F.when(F.col("cls") == F.col("truth"), F.col("a")).otherwise(0.0))
    u = classify.soft_assignment(scored).groupBy("ex").agg(own.alias("u"))
    soft = iterate.em_by_class(examples(spark, sf).join(u, "ex"), DIM, CLASSES, 2, rounds=2, weight="u")
    return soft.groupBy("cls").agg(F.round(F.sum("ll"), 3).alias("loglik"))


_SWEEP = "SELECT e.vec_id AS ex, k.k * 100 + s.seed AS node, k.k, s.seed, 1e0 AS u FROM embeddings e CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) k CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed) s"


@query(f"WITH {BITS}, " + ",\n".join(_node_em(4, _SWEEP, "(mem.ex % 65521 * 40503 + mem.seed * 30341) % 65521 % mem.k")) + " SELECT (node // 100)::INT AS k, (node % 100)::INT AS seed, round(sum(l), 4) AS loglik FROM l3 GROUP BY node")
def em_sweep(spark, sf):
    """Log likelihoods of mixtures of 2, 3 and 4 components from three starts each, all fitted in the same passes."""
    swept, _ = iterate.sweep(examples(spark, sf), DIM, [2, 3, 4], seeds=[1, 2, 3], rounds=4)
    return swept.select("k", "seed", F.round("loglik", 4).alias("loglik"))


@query("SELECT k, min(seed) AS seed, max(loglik) AS loglik FROM (SELECT *, max(loglik) OVER (PARTITION BY k) AS top FROM (" + ORACLE["em_sweep"] + ")) WHERE loglik = top GROUP BY 1")
def em_restarts(spark, sf):
    """Log likelihood and seed of the best of three starts of mixtures of 2, 3 and 4 components."""
    swept = em_sweep(spark, sf)
    return swept.groupBy("k").agg(F.max(F.struct("loglik", (-F.col("seed")).alias("s"))).alias("best")).select("k", (-F.col("best.s")).alias("seed"), "best.loglik")


#: Mass that a component of the inner mixtures asks for, and the most components of one.
LEAST, MOST = 5, 3
_OUTER = ORACLE["em_2iter"].replace(" SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a2", "").replace("WITH ", "", 1)
for _n in ("a0", "a1", "a2", "t0", "t1", "p0", "p1", "k0", "k1", "z0", "z1", "x0", "x1", "s0", "s1"):
    _OUTER = re.sub(rf"\b{_n}\b", f"outer_{_n}", _OUTER)
TREE = f"WITH {_OUTER}, tree AS MATERIALIZED (SELECT cls, cluster, mass, least(mass // {LEAST}, {MOST})::INT AS k FROM (SELECT e.label AS cls, a.comp::INT AS cluster, floor(round(sum(a.a), 6))::BIGINT AS mass FROM outer_a2 a JOIN embeddings e ON e.vec_id = a.ex GROUP BY 1, 2))"
_INNER = "SELECT a.ex, tree.cls::BIGINT * 3 + tree.cluster AS node, tree.k, 1e0 AS u FROM outer_a2 a JOIN embeddings e ON e.vec_id = a.ex JOIN tree ON tree.cls = e.label AND tree.cluster = a.comp WHERE a.a > 9e-1 AND tree.k > 0"


def _nested(spark, sf):
    return mixtures.nested(examples(spark, sf), DIM, 3, least=LEAST, most=MOST, rounds=2)


@query(f"{TREE} SELECT cls, cluster, mass, CASE WHEN k > 0 THEN cls::BIGINT * 3 + cluster END AS node, k FROM tree")
def cluster_tree(spark, sf):
    """Clusters over all classes, the classes' mass in each, and how many components the pair gets of its own."""
    return _nested(spark, sf)[0].select("cls", "cluster", "mass", "node", "k")


@query(TREE + ",\n" + ",\n".join(_node_em(2, _INNER)) + " SELECT ex, (node // 3)::BIGINT AS cls, (node % 3)::INT AS cluster, comp, round(a, 6) AS a FROM a2")
def nested_clusters(spark, sf):
    """Responsibilities of the components inside each (class, cluster), all fitted together."""
    leaves = _nested(spark, sf)[1]
    return leaves.select("ex", F.col("cls").cast("long").alias("cls"), "cluster", F.posexplode("a").alias("comp", "a")).select("ex", "cls", "cluster", "comp", F.round("a", 6).alias("a"))


def _joint_sql(rounds: int) -> str:
    members = "SELECT vec_id AS ex, label AS node, 2 AS k, 1e0 AS u FROM embeddings"
    parts = [BITS, *_node_em(0, members), "w0 AS MATERIALIZED (SELECT ex, node, comp, a AS a, 1e0 AS u FROM a0)"]
    for r in range(rounds):
        parts += [
            f"t{r} AS MATERIALIZED (SELECT node, comp, sum(a * u) AS t FROM w{r} GROUP BY 1, 2)",
            f"s{r} AS MATERIALIZED (SELECT a.node, a.comp, o.d, sum(a.a * a.u) AS s FROM w{r} a JOIN ones o USING (ex) GROUP BY 1, 2, 3)",
            f"p{r} AS MATERIALIZED (SELECT node, comp, d, greatest(least(coalesce(s, 0) / greatest(t, 1e-300), 99e-2), 1e-2) AS p FROM gd JOIN t{r} USING (node, comp) LEFT JOIN s{r} USING (node, comp, d))",
            f"b{r} AS MATERIALIZED (SELECT node, comp, c + ln(greatest(t / sum(t) OVER (PARTITION BY node), 1e-300)) AS b FROM (SELECT node, comp, sum(ln(1 - p)) AS c FROM p{r} GROUP BY 1, 2) JOIN t{r} USING (node, comp))",
            f"z{r} AS MATERIALIZED (SELECT mem.ex, mem.node AS own, b.node, b.comp, b.b + coalesce(q.s, 0) AS z FROM mem CROSS JOIN b{r} b LEFT JOIN (SELECT o.ex, p.node, p.comp, sum(ln(p.p) - ln(1 - p.p)) AS s FROM ones o JOIN p{r} p USING (d) GROUP BY 1, 2, 3) q ON q.ex = mem.ex AND q.node = b.node AND q.comp = b.comp)",
            f"u{r} AS MATERIALIZED (SELECT ex, coalesce(sum(exp(y)) FILTER (WHERE node = own), 0) / sum(exp(y)) AS u FROM (SELECT *, z - max(z) OVER (PARTITION BY ex) AS y FROM z{r}) WHERE y > -138e-1 GROUP BY 1)",
            f"w{r + 1} AS MATERIALIZED (SELECT ex, node, comp, exp(z - x) / sum(exp(z - x)) OVER (PARTITION BY ex) AS a, u FROM (SELECT *, max(z) OVER (PARTITION BY ex) AS x FROM z{r} WHERE own = node) JOIN u{r} USING (ex))",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT ex, round(u, 6) AS u FROM u{rounds - 1}"


@query(_joint_sql(3))
def em_joint(spark, sf):
    """Weights by the posterior of the own class, taken anew in each of three rounds over the mixtures of all classes."""
    weighed, _, _ = mixtures.joint(examples(spark, sf), DIM, 2, len(CLASSES), rounds=3)
    return weighed.select("ex", F.round("u", 6).alias("u"))

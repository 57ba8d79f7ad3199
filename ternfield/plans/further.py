"""Queries over parts, samples, soft transitions and examples stored by class."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ternfield.operators import iterate, patches, samples
from ternfield.plans import catalog, models
from ternfield.plans.catalog import BITS, DIM, ORACLE, examples, query
from ternfield.plans.learning import _node_em
from ternfield.sources import by_class
from ternfield.sources.scratch import shared_dir
from ternfield.sources.tables import table

PARTS_SQL = models.LEARNT.replace(
    " SELECT ex, comp::INT AS comp, round(a, 6) AS a FROM a2",
    """, kp AS (SELECT comp, sum(a) AS mass FROM a2 GROUP BY 1 HAVING sum(a) > 30),
vals AS (SELECT (ex * 9 + (d // 16 - i) * 3 + (d // 4 % 4 - j))::BIGINT AS ex, ((i * 2 + j) * 4 + d % 4)::INT AS d, v FROM bits CROSS JOIN (SELECT unnest(range(2)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS j) WHERE d // 16 - i BETWEEN 0 AND 2 AND d // 4 % 4 - j BETWEEN 0 AND 2),
mn AS (SELECT comp, d, sum(a * v) / sum(a) AS m FROM a2 JOIN vals USING (ex) GROUP BY 1, 2)
SELECT kp.comp::INT AS part, mn.d, round(p1.p, 6) AS template, round(mn.m, 6) + 0e0 AS mean_patch FROM kp JOIN p1 USING (comp) JOIN mn ON mn.comp = kp.comp AND mn.d = p1.d""",
)


@query(PARTS_SQL)
def part_templates(spark, sf):
    """Templates of the learnt parts and the mean raw patch under each."""
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.posexplode("embedding").alias("d", "s"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(2) for j in range(2)])
    at = cells.select("ex", F.floor(F.col("d") / 16).alias("t"), F.floor(F.col("d") / 4).cast("int").alias("r"), (F.col("d") % 4).alias("e"), "s", F.explode(near).alias("o"))
    at = at.select((F.col("ex") * 9 + (F.col("t") - F.col("o.i")) * 3 + (F.col("r") % 4 - F.col("o.j"))).alias("ex"), (F.col("t") - F.col("o.i")).alias("t"), (F.col("r") % 4 - F.col("o.j")).alias("f"), ((F.col("o.i") * 2 + F.col("o.j")) * 4 + F.col("e")).alias("d"), "s")
    at = at.where(F.col("t").between(0, 2) & F.col("f").between(0, 2))
    values = at.groupBy("ex").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda c: c["s"]).alias("v"))  # 16 a patch
    parts = patches.learn_parts(models._patch_examples(spark, sf), values, 16, 3, least=30.0, rounds=2)
    long = parts.select("part", "mean_patch", F.posexplode("template").alias("d", "p"))
    return long.select("part", "d", F.round("p", 6).alias("template"), (F.round(F.get("mean_patch", F.col("d")), 6) + 0.0).alias("mean_patch"))


@query("SELECT ex, part, count(*) AS n, string_agg(t || ':' || f, ',' ORDER BY t, f) AS places FROM (" + ORACLE["part_codes"] + ") GROUP BY 1, 2")
def active_parts(spark, sf):
    """Where each part is active in each example."""
    found = patches.part_places(catalog.QUERIES["part_codes"](spark, sf))
    return found.select("ex", "part", "n", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["t"].cast("string"), p["f"].cast("string"))), ",").alias("places"))


def _keyed_sql(row_id: str, seed: int) -> str:
    return f"((({row_id} % 2147483647 * 48271 + {1_000_003 * (seed + 1)}) % 2147483647) * 69621 + {7_919 * (seed + 1)}) % 2147483647"


@query(f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS r FROM (SELECT source, doc_id, {_keyed_sql('doc_id', 3)} AS k FROM documents)) WHERE r <= 20 ORDER BY k, doc_id LIMIT 150")
def bounded_sample(spark, sf):
    """At most 20 documents a source and 150 in all; both caps bind."""
    return samples.capped_sample(table(spark, sf, "documents").select("source", "doc_id"), "doc_id", "source", per_class=20, total=150, seed=3)


@query(f"SELECT vec_id AS ex, row_number() OVER (ORDER BY {_keyed_sql('vec_id', 5)}) - 1 AS place FROM embeddings")
def shuffled_cursor(spark, sf):
    """Every example's place in a keyed order."""
    return samples.cursor(table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex")), "ex", seed=5)


_LETTERS = "ones AS (SELECT conv_id * 1000 + turn AS ex, d FROM conversations CROSS JOIN (SELECT unnest(range(26))::INT AS d) WHERE contains(coalesce(text, ''), chr(97 + d)))"


@query(f"WITH {_LETTERS}, " + ",\n".join(_node_em(2, "SELECT conv_id * 1000 + turn AS ex, 0 AS node, 3 AS k, 1e0 AS u FROM conversations")).replace("range(64)", "range(26)") + " SELECT w.comp AS prev, a.comp AS next, round(sum(w.a * a.a) / sum(w.a), 6) AS p FROM a2 w JOIN a2 a ON a.ex = w.ex + 1 GROUP BY 1, 2")
def soft_transitions(spark, sf):
    """How turns' clusters by letters follow one another within conversations, by responsibilities."""
    turn = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ex"), F.col("conv_id").alias("seq"), F.col("turn").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    letters = F.filter(F.sequence(F.lit(0), F.lit(25)), lambda d: F.contains("text", F.char(d + 97)))
    soft, _ = iterate.em(turn.select("ex", "seq", "t", letters.alias("idx")), 26, 3, rounds=2)
    return iterate.soft_transitions(soft, 3).select("prev", "next", F.round("p", 6).alias("p"))


@query(f"WITH {BITS} SELECT e.vec_id AS ex, e.label::INT AS cls, (e.label // 2)::INT AS reduced, count(o.d) + 1 AS on_with_ones FROM embeddings e LEFT JOIN ones o ON o.ex = e.vec_id WHERE e.label >= 3 OR e.vec_id % 2 = 0 GROUP BY 1, 2, 3")
def class_store(spark, sf):
    """Examples stored by class; classes 0 to 2 stored again with half of theirs; all read back with a column of ones."""
    folder, rows = f"{shared_dir(spark)}/classes-{uuid.uuid4().hex}", examples(spark, sf)
    by_class.write_by_class(rows, folder)
    by_class.write_by_class(rows.where("cls < 3 AND ex % 2 = 0"), folder)
    read = by_class.read_by_class(spark, folder, bias=DIM, reduced={c: c // 2 for c in range(10)})
    return read.select("ex", "cls", "reduced", F.size("idx").cast("long").alias("on_with_ones"))

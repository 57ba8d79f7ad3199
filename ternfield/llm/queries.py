"""The queries opN_* over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternfield.llm.common import fold, table
from ternfield.llm import byte_bpe, decontaminate, licences, line_dedup, media, merkle, minhash, mixing, pii, prefix_trie, quality, token_files, toxicity


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_lines(docs, line_dedup.line_keep_bitmaps(docs))
    n = F.size("__lines").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("__kept")).alias("n_dropped"), F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, f.first_doc < k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.token_folder(docs)
    return token_files.read_tokens(token_files.write_tokens(docs, folder), folder)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = media.media_columns(media.stored_bytes(media.store_text(docs)))
    t = F.col("tracks")[0]
    spans = F.array_join(F.transform(t["keyframes"], lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    return kept.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", t["codec"], t["seconds"].cast("string"), t["n_samples"].cast("string"), spans).alias("feature"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks_by_document(docs, table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _scored(docs: DataFrame, held_out) -> DataFrame:
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), train_if=~held_out)
    return _scored(quality.score(docs, model).drop("text"), held_out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_if=~held_out)
    return _scored(toxicity.score(docs, net).drop("text"), held_out)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the decoded bytes."""
    ids = F.col("ids")
    coded = byte_bpe.encode(docs.select("doc_id", "text")).drop("text")
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(ids), 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.licences(docs, licences.fit(docs))
    families = F.transform("licences", lambda x: x["family"])
    n_unknown = F.size(families) - F.size(F.array_remove(families, licences.UNKNOWN))
    paragraphs = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",")
    return found.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_paragraphs"),
        F.size(families).cast("long").alias("n_licences"),
        n_unknown.cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("families"),
        paragraphs.alias("paragraphs"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the texts lose their line ends before they are held against their proofs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.document_manifest(docs, changed=F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


#: crc32 of a short ASCII text in SQL, given the table of its 256 bytes as ``crc``.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END))"


def crc_sql(text: str) -> str:
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, crc[xor(c & 255, b) + 1])))"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_PARTS = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS crc),
d AS (SELECT doc_id, source, sha256({_PARTS} || {_field_sql('text')}) AS leaf,
             CASE WHEN {crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN sha256({_PARTS} || {_field_sql("replace(text, chr(10), '')")}) ELSE sha256({_PARTS} || {_field_sql('text')}) END AS other FROM documents, t),
s AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM (SELECT DISTINCT source FROM d)),
p AS (SELECT d.*, s.sid, row_number() OVER (PARTITION BY s.sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
low AS (SELECT sid, 0 AS h, pos, leaf AS digest, count(*) OVER (PARTITION BY sid) AS n FROM p
        UNION ALL SELECT sid, h, pos, digest, (n + 2) // 3 FROM (SELECT sid, h + 1 AS h, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, any_value(n) AS n FROM low WHERE n > 1 GROUP BY sid, h, pos // 3)),
sub AS (SELECT sid, digest FROM low WHERE n = 1),
top AS (SELECT 0 AS h, sid AS pos, digest, (SELECT count(*) FROM s) AS n FROM sub
        UNION ALL SELECT h, pos, digest, (n + 2) // 3 FROM (SELECT h + 1 AS h, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, any_value(n) AS n FROM top WHERE n > 1 GROUP BY h, pos // 3)),
lr AS (SELECT a.sid, a.h, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
       FROM low a JOIN low b ON a.sid = b.sid AND a.h = b.h AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
tr AS (SELECT a.h, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
       FROM top a JOIN top b ON a.h = b.h AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2),
way AS (SELECT p.sid, p.pos, lr.h, lr.l, lr.r FROM p JOIN lr ON lr.sid = p.sid AND lr.pos = p.pos // (3 ** lr.h)::BIGINT
        UNION ALL SELECT p.sid, p.pos, 1000 + tr.h, tr.l, tr.r FROM p JOIN tr ON tr.pos = p.sid // (3 ** tr.h)::BIGINT),
w AS (SELECT sid, pos, list(struct_pack(l := l, r := r) ORDER BY h) AS ws FROM way GROUP BY 1, 2),
f AS (SELECT p.sid, p.pos, 1 AS i, p.other AS node, coalesce(w.ws, []) AS ws FROM p LEFT JOIN w USING (sid, pos)
      UNION ALL SELECT sid, pos, i + 1, sha256(ws[i].l || node || ws[i].r), ws FROM f WHERE i <= len(ws)),
g AS (SELECT sid, pos, node, ws FROM f WHERE i = len(ws) + 1)
SELECT p.doc_id, p.leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(list_aggregate(list_prepend('', list_transform(g.ws, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256,
       g.node AS folded_root, g.node = (SELECT digest FROM top WHERE n = 1) AS verified, list_sum(list_prepend(0, list_transform(g.ws, lambda x: (length(x.l) + length(x.r)) // 64)))::BIGINT AS n_siblings
FROM p JOIN g USING (sid, pos) JOIN sub USING (sid)
"""

OP13_SQL = f"""
WITH t AS (SELECT {CRC_TABLE} AS crc),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql('conv_id::VARCHAR')} % 4 AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), t),
l AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT l.conv_id, o.i, o.role, o.text FROM l JOIN o ON o.conv_id = l.base AND o.i < l.lent
      UNION ALL SELECT l.conv_id, o.i - l.h + l.lent, o.role, o.text FROM l JOIN o ON o.conv_id = l.conv_id AND o.i >= l.h),
q AS (SELECT c.conv_id, coalesce(ts, []) AS ts FROM c LEFT JOIN (SELECT conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY i) AS ts, FROM r GROUP BY 1) USING (conv_id)),
e AS (SELECT conv_id, d, list_slice(ts, 1, d) AS k, list_slice(ts, 1, d - 1) AS pk, d = len(ts) AS ends FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM q)),
w AS (SELECT conv_id, i + 1 AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
n AS (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM e GROUP BY 1, 2),
m AS (SELECT n.*, (n_convs - 1) * coalesce(words, 0) AS saved, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.pk = n.k) AS n_children FROM n LEFT JOIN w ON w.conv_id = n.conv_id AND w.d = n.d),
a AS (SELECT m.d - u AS up, list_slice(m.k, 1, m.d - u) AS k, m.n_children = 0 AS leaf, m.saved FROM m, LATERAL (SELECT unnest(range(m.d + 1)) AS u)),
b AS (SELECT up AS d, k, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) AS below FROM a GROUP BY 1, 2),
z AS (SELECT m.*, row_number() OVER (ORDER BY list_transform(m.k, lambda x: upper(x))) - 1 AS preorder FROM m)
SELECT z.conv_id, z.d AS depth, p.conv_id AS parent_conv_id, z.n_convs, z.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(z.ends, '')) AS ends_sha256, z.preorder, (z.preorder + b.below)::BIGINT AS subtree_end
FROM z JOIN b ON b.d = z.d AND b.k = z.k LEFT JOIN m p ON z.d > 0 AND p.d = z.d - 1 AND p.k = z.pk
"""

QUERIES = {
    "op1_licences": op1_licences,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_minhash": op5_minhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_media_columns": op8_media_columns,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {"op2_line_dedup": OP2_SQL, "op12_merkle": OP12_SQL, "op13_prefix_trie": OP13_SQL}

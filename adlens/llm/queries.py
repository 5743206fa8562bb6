"""Registered queries of the training-data operators. SQL twins: ``SQL``; queries without one are tested on small fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm.boilerplate import boilerplate_lists
from adlens.llm.common import texts
from adlens.llm.contamination import leaked
from adlens.llm.lookalike import ALIKE, respelled
from adlens.llm.mojibake import mojibake
from adlens.llm.nearest import near_pairs, neighbours
from adlens.llm.packing import fill_rates, packed
from adlens.llm.pii import personal_information, redacted
from adlens.llm.residue import residue, validated
from adlens.llm.simcluster import described, linked
from adlens.session import table, written


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return mojibake(texts(spark, root), restore=False).select("src", "rec_id").distinct()


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    return mojibake(texts(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return linked(table(spark, root, "emb"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return described(table(spark, root, "emb"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return near_pairs(table(spark, root, "emb"))


def p3_texts(spark: SparkSession, root: str) -> DataFrame:
    emb = table(spark, root, "emb")
    return neighbours(emb).join(emb.select(F.col("vec_id").alias("other_id"), "text"), "other_id")


def keyword_spellings(spark: SparkSession, root: str) -> DataFrame:
    emb = table(spark, root, "emb").select(F.lit("emb").alias("src"), F.col("vec_id").alias("rec_id"), F.lit(0).alias("pos"), "text")
    members = table(spark, root, "clusters").select(F.lit("clusters").alias("src"), F.col("cluster_id").alias("rec_id"), F.posexplode("members").alias("pos", "text"))
    return emb.unionByName(members)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return respelled(keyword_spellings(spark, root), table(spark, root, "keywords"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return residue(texts(spark, root)).select("src", "rec_id").distinct()


def p5_validation(spark: SparkSession, root: str) -> DataFrame:
    return validated(texts(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    rows = texts(spark, root)
    cases = written(residue(rows).select("src", "rec_id"))
    return boilerplate_lists(rows).join(cases, ["src", "rec_id"], "left_anti").select("src", "rec_id", F.explode("line_nos").alias("line_no"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packed(table(spark, root, "documents"), table(spark, root, "containers"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return fill_rates(p8_packed(spark, root), table(spark, root, "containers"))


def p8_sound(spark: SparkSession, root: str) -> DataFrame:
    """(container_kind, texts, overfull, broken): texts packed, containers above their capacity, texts split although they fit or not whole."""
    boxes = table(spark, root, "containers")
    out = written(packed(table(spark, root, "documents"), boxes)).join(boxes, "container_kind")
    over = out.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("most")).groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("most")).alias("overfull"))
    per = out.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("capacity_tokens").alias("most"))
    broken = (F.col("n") != F.col("end")) | (F.col("pieces") != F.greatest(F.ceil(F.col("n") / F.col("most")), F.lit(1)))
    return per.groupBy("container_kind").agg(F.count("*").alias("texts"), F.count_if(broken).alias("broken")).join(over, "container_kind").select("container_kind", "texts", "overfull", "broken")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked(table(spark, root, "documents"), table(spark, root, "benchmark"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return personal_information(table(spark, root, "documents")).select("doc_id", "pii_kind", "start_at").distinct()


def p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    return redacted(table(spark, root, "documents"))


def p10_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, same): whether the replaced text with the values put back is the text."""
    docs = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    values = personal_information(docs).join(docs, "doc_id").select("doc_id", "start_at", F.substring("text", F.col("start_at") + 1, F.col("end_at") - F.col("start_at")).alias("value"), F.concat(F.lit("<"), F.upper("pii_kind"), F.lit(">")).alias("mark"))
    held = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "value", "mark"))).alias("held"))
    # Each value goes where its placeholder stands: all before it are whole again, so its offset is the text's own.
    back = lambda t, v: F.concat(F.substring(t, F.lit(1), v["start_at"]), v["value"], F.substring(t, v["start_at"] + 1 + F.length(v["mark"]), F.length(t)))
    plain = redacted(docs).withColumnRenamed("text", "plain").join(docs, "doc_id").join(held, "doc_id", "left")
    return plain.select("doc_id", (F.coalesce(F.aggregate("held", F.col("plain"), back), F.col("plain")) == F.col("text")).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_texts": p3_texts, "p4_found": p4_found, "p5_found": p5_found, "p5_validation": p5_validation, "p7_found": p7_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_sound": p8_sound, "p9_found": p9_found, "p10_found": p10_found, "p10_redacted": p10_redacted, "p10_round_trip": p10_round_trip,
}

_USABLE = """u AS (SELECT vec_id, text, hash(coalesce(provider, ''), coalesce(model, ''), coalesce(req_dim, -1)) AS space, CAST(vec AS DOUBLE[]) AS v FROM emb
 WHERE vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"""

_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_OTHERS, _OWN = ("".join(x) for x in zip(*((c, row[0]) for row in ALIKE for c in row[1:])))
_CANON = f"""nfc_normalize(trim(regexp_replace(replace(replace(translate(translate(regexp_replace(text, '[\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180b}}-\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2069}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g'), '{_WIDE}', '{_NARROW}'), '{_OTHERS}', '{_OWN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
 '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')))"""

SQL: dict[str, str] = {
    "p4_found": f"""WITH t AS (SELECT 'emb' AS src, vec_id AS rec_id, 0 AS pos, text FROM emb UNION ALL SELECT 'clusters', cluster_id, CAST(generate_subscripts(members, 1) - 1 AS INTEGER), unnest(members) FROM clusters),
k AS (SELECT kw_id, text AS own, {_CANON} AS canon FROM keywords WHERE text IS NOT NULL), f AS (SELECT src, rec_id, pos, text, {_CANON} AS canon FROM t WHERE text IS NOT NULL)
SELECT DISTINCT src, rec_id, pos, kw_id FROM f JOIN k USING (canon) WHERE text <> own""",
    "p8_sound": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS broken FROM containers",
    "p10_round_trip": "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL",
    "p2_found": f"""WITH RECURSIVE {_USABLE},
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.space = b.space AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT min(b) AS root_id, a AS vec_id FROM r GROUP BY a HAVING min(b) < a""",
    "p3_found": f"""WITH {_USABLE},
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.space = b.space AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS r FROM s WHERE c >= 0.8)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k WHERE r <= 5""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 12), ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b))
SELECT DISTINCT doc_id, item_id FROM dw JOIN bw USING (p)""",
}

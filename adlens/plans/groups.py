"""Queries over keyword groups, similarity, vectors and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.text import keyword_tokens
from adlens.operators.keyword_clusters import cluster_ids, distinct_labels, keyword_clusters, labels, medoids, rollup, title_case, two_stage_clusters, vector_clusters
from adlens.operators.similarity import blocked_vector_links, token_links
from adlens.operators.whitening import whitened
from adlens.session import table
from adlens.sources.caches import alive, newest, request_key, split_requests, statistics


def _heads(spark: SparkSession, root: str) -> DataFrame:
    """Keywords grouped by the first token."""
    k = table(spark, root, "keywords")
    return k.withColumn("cluster", keyword_tokens(F.col("text"))[0])


def k1_rollup(spark: SparkSession, root: str) -> DataFrame:
    return rollup(_heads(spark, root)).withColumn("avg_cpc", F.round("avg_cpc", 8))


def k5_labels(spark: SparkSession, root: str) -> DataFrame:
    return labels(_heads(spark, root))


def k6_distinct_labels(spark: SparkSession, root: str) -> DataFrame:
    members = _heads(spark, root)
    return distinct_labels(labels(members), members)


def p7_min_size(spark: SparkSession, root: str) -> DataFrame:
    return rollup(_heads(spark, root)).filter("size >= 5").select("cluster", "size")


def o4_by_volume(spark: SparkSession, root: str) -> DataFrame:
    """Top-20 report of groups by volume, then size."""
    out = rollup(_heads(spark, root)).select("cluster", "size", F.coalesce("total_volume", F.lit(0)).alias("volume"))
    return out.orderBy(F.desc("volume"), F.desc("size"), "cluster").limit(20)


def k12_card(spark: SparkSession, root: str) -> DataFrame:
    """Volumes per cluster of an earlier run, from today's keywords."""
    members = table(spark, root, "clusters").select("cluster_id", F.explode("members").alias("text"))
    vols = table(spark, root, "keywords").select("text", "avg_monthly_searches")
    return members.join(vols, "text", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum("avg_monthly_searches").alias("volume"))


def x1_links(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "keywords").select(F.col("kw_id").alias("id"), "text")
    return token_links(texts, 0.5).select(F.col("id").alias("kw_id"), "links")


def g1_components(spark: SparkSession, root: str) -> DataFrame:
    return cluster_ids(table(spark, root, "keywords"), "tokens", 0.8).select("kw_id", "root", "component")


def g3_semantic_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Token groups with their rollup, singles left out."""
    ids = cluster_ids(table(spark, root, "keywords"), "tokens", 0.8)
    members = table(spark, root, "keywords").join(ids.select("kw_id", F.col("component").alias("cluster")), "kw_id")
    return rollup(members).filter("size >= 2").withColumn("avg_cpc", F.round("avg_cpc", 8))


def _keyword_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(text, vec): the newest whole vector of each text by the model with the shorter vectors."""
    e = table(spark, root, "emb").filter("text IS NOT NULL AND vec IS NOT NULL AND size(vec) = dim AND NOT exists(vec, x -> x IS NULL OR isnan(x)) AND exists(vec, x -> x <> 0)")
    short = e.agg(F.min("dim").alias("dim"))
    return newest(e.join(F.broadcast(short), "dim").select("text", "vec", "cached_at", "vec_id"), ["text"], "cached_at", "vec_id").select("text", "vec")


def g4_semantic(spark: SparkSession, root: str) -> DataFrame:
    """Keywords grouped by the cosine of their cached vectors, with rollups."""
    out = keyword_clusters(table(spark, root, "keywords"), "semantic", 0.9, vectors=_keyword_vectors(spark, root), whitening="none")[0]
    return out.select("cluster", "size", "total_volume", F.round("avg_cpc", 8).alias("avg_cpc"), "dominant_competition", "representative_keyword", F.array_join("members", "|").alias("members"))


def g4_noise(spark: SparkSession, root: str) -> DataFrame:
    return keyword_clusters(table(spark, root, "keywords"), "semantic", 0.9, vectors=_keyword_vectors(spark, root), whitening="none")[1]


def g4_whitened(spark: SparkSession, root: str) -> DataFrame:
    """The same on vectors whitened as a batch."""
    return keyword_clusters(table(spark, root, "keywords"), "auto", vectors=_keyword_vectors(spark, root))[0].select("cluster", "size", "label", "representative_keyword")


def x5_two_stage(spark: SparkSession, root: str) -> DataFrame:
    """Semantic groups, and fuzzy ones of what they leave."""
    return two_stage_clusters(table(spark, root, "keywords"), _keyword_vectors(spark, root), 0.9, whitening="none").select("stage", "cluster", "size", "label")


def k1_members(spark: SparkSession, root: str) -> DataFrame:
    return rollup(_heads(spark, root), members=True).select("cluster", F.array_join("members", "|").alias("members"))


def k13_medoids(spark: SparkSession, root: str) -> DataFrame:
    return medoids(table(spark, root, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("vec")))


def k5_titles(spark: SparkSession, root: str) -> DataFrame:
    return labels(_heads(spark, root)).select("cluster", title_case(F.col("label")).alias("title"))


def g2_vector_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups of embeddings with a cosine of 0.5 and more."""
    rows = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector_clusters(rows, 0.5)[0].select("id", "root")


def j5_vector_links(spark: SparkSession, root: str) -> DataFrame:
    """For each embedding the number of others with a cosine of 0.5 and more."""
    rows = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    links = blocked_vector_links(rows, 0.5)
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    return rows.select("id").join(ends.groupBy("id").agg(F.count("*").alias("links")), "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def f13_whitened(spark: SparkSession, root: str) -> DataFrame:
    return whitened(table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 64)


def s8_cache_statistics(spark: SparkSession, root: str) -> DataFrame:
    return statistics(table(spark, root, "emb"), ["provider", "model", "dim"])


def s9_alive(spark: SparkSession, root: str) -> DataFrame:
    """Newest vector per key, not older than 30 days on 2024-06-01."""
    entries = table(spark, root, "emb").select("provider", "model", "req_dim", "text", "cached_at", "vec_id").filter("text IS NOT NULL AND cached_at IS NOT NULL")
    held = newest(entries, ["provider", "model", "req_dim", "text"], "cached_at", "vec_id")
    return alive(held, "cached_at", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), 30 * 86400.0).select("text", "vec_id")


def s9_keys(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("engine", F.lit("")).alias("engine"))
    return p.select("page_id", request_key(F.col("url"), F.col("engine")).alias("key"))


def j12_hits(spark: SparkSession, root: str) -> DataFrame:
    return split_requests(table(spark, root, "search_terms").select(F.col("term").alias("text")), table(spark, root, "emb"), "text")[0]


def j12_misses(spark: SparkSession, root: str) -> DataFrame:
    return split_requests(table(spark, root, "search_terms").select(F.col("term").alias("text")), table(spark, root, "emb"), "text")[1]


def x3_distinct_in_order(spark: SparkSession, root: str) -> DataFrame:
    """Each cached text once, at its first position."""
    return table(spark, root, "emb").filter("text IS NOT NULL").groupBy("text").agg(F.min("vec_id").alias("first_id"))


QUERIES = {
    "k1_rollup": k1_rollup, "k5_labels": k5_labels, "k6_distinct_labels": k6_distinct_labels, "min_cluster_size": p7_min_size, "o4_by_volume": o4_by_volume, "k12_card": k12_card, "x1_links": x1_links, "g1_components": g1_components,
    "g3_token_groups": g3_semantic_rollup, "k13_medoids": k13_medoids, "f13_whitened": f13_whitened, "k5_titles": k5_titles, "g2_vector_groups": g2_vector_groups, "j5_vector_links": j5_vector_links, "s8_cache_statistics": s8_cache_statistics, "s9_alive": s9_alive, "s9_keys": s9_keys, "j12_hits": j12_hits, "j12_misses": j12_misses, "x3_distinct_in_order": x3_distinct_in_order,
    "g4_semantic": g4_semantic, "g4_noise": g4_noise, "g4_whitened": g4_whitened, "x5_two_stage": x5_two_stage, "k1_members": k1_members,
}

_TOKS = r"regexp_extract_all(trim(regexp_replace(strip_accents(translate(lower(coalesce(text, '')), 'łđø', 'ldo')), '\s+', ' ', 'g')), '[\p{L}\p{N}]+')"
_MEMBERS = f"m AS (SELECT *, {_TOKS} AS toks FROM keywords), h AS (SELECT *, toks[1] AS cluster FROM m WHERE text IS NOT NULL)"
_RANK = "CASE competition WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_LABELS = """g AS (SELECT DISTINCT cluster, kw_id, s.n, array_to_string(list_slice(toks, p.i, p.i + s.n - 1), ' ') AS ngram FROM h, (SELECT unnest([1, 2, 3]) AS n) s, (SELECT unnest(range(1, 40)) AS i) p WHERE p.i + s.n - 1 <= len(toks)),
c AS (SELECT cluster, n, ngram, count(*) AS held FROM g GROUP BY ALL HAVING count(*) >= 2 OR n = 1),
l AS (SELECT cluster, ngram AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, held DESC, ngram) AS r FROM c) WHERE r = 1)"""

_ROLLED = f"""count(*) AS size, CAST(sum(avg_monthly_searches) AS BIGINT) AS total_volume, round(avg((cpc_low + cpc_high) / 2), 8) AS avg_cpc,
 arg_max(competition, {{'r': {_RANK}, 'k': -kw_id}}) FILTER (WHERE coalesce(competition, '') <> '') AS dominant_competition,
 coalesce(arg_max(text, {{'v': avg_monthly_searches, 'k': -kw_id}}) FILTER (WHERE avg_monthly_searches IS NOT NULL), arg_min(text, {{'l': length(text), 'k': kw_id}})) AS representative_keyword"""
_TOKEN_GROUPS = f"""m AS (SELECT *, list_distinct({_TOKS}) AS s FROM keywords WHERE text IS NOT NULL), t AS (SELECT kw_id, len(s) AS n, unnest(s) AS w FROM m),
e AS MATERIALIZED (SELECT a.kw_id AS x, b.kw_id AS y FROM t a JOIN t b ON a.w = b.w AND a.kw_id <> b.kw_id GROUP BY a.kw_id, b.kw_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
rooted AS (SELECT kw_id, coalesce(least(min(y), kw_id), kw_id) AS root FROM m LEFT JOIN r ON x = kw_id GROUP BY kw_id),
grouped AS (SELECT kw_id, root, dense_rank() OVER (ORDER BY root) - 1 AS component FROM rooted)"""
_VECTORS = """fine AS (SELECT * FROM emb WHERE text IS NOT NULL AND vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
newer AS (SELECT text, CAST(vec AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY text ORDER BY cached_at DESC NULLS LAST, vec_id DESC) AS r FROM fine WHERE dim = (SELECT min(dim) FROM fine)),
held AS (SELECT kw_id, v FROM keywords JOIN newer USING (text) WHERE r = 1),
e AS MATERIALIZED (SELECT a.kw_id AS x, b.kw_id AS y FROM held a JOIN held b ON a.kw_id <> b.kw_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
grouped AS (SELECT x AS kw_id, min(y) AS cluster FROM r GROUP BY x)"""

SQL = {
    "k1_rollup": f"""WITH {_MEMBERS}
SELECT cluster, count(*) AS size, CAST(sum(avg_monthly_searches) AS BIGINT) AS total_volume, round(avg((cpc_low + cpc_high) / 2), 8) AS avg_cpc,
 arg_max(competition, {{'r': {_RANK}, 'k': -kw_id}}) FILTER (WHERE coalesce(competition, '') <> '') AS dominant_competition,
 coalesce(arg_max(text, {{'v': avg_monthly_searches, 'k': -kw_id}}) FILTER (WHERE avg_monthly_searches IS NOT NULL), arg_min(text, {{'l': length(text), 'k': kw_id}})) AS representative_keyword
FROM h GROUP BY cluster""",
    "k5_labels": f"WITH {_MEMBERS}, {_LABELS} SELECT cluster, label FROM l",
    "k6_distinct_labels": f"""WITH {_MEMBERS}, {_LABELS},
clash AS (SELECT * FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) > 1)),
w AS (SELECT DISTINCT h.cluster, label, kw_id, unnest(toks) AS word FROM h JOIN clash USING (cluster)),
x AS (SELECT cluster, word, count(*) AS held FROM w WHERE NOT list_contains(string_split(label, ' '), word) GROUP BY cluster, word),
e AS (SELECT cluster, word AS extra FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY held DESC, word) AS r FROM x) WHERE r = 1)
SELECT cluster, CASE WHEN extra IS NULL THEN label ELSE label || ' ' || extra END AS label FROM l LEFT JOIN e USING (cluster)""",
    "min_cluster_size": f"WITH {_MEMBERS} SELECT cluster, count(*) AS size FROM h GROUP BY cluster HAVING count(*) >= 5",
    "o4_by_volume": f"WITH {_MEMBERS} SELECT cluster, count(*) AS size, CAST(coalesce(sum(avg_monthly_searches), 0) AS BIGINT) AS volume FROM h GROUP BY cluster ORDER BY volume DESC, size DESC, cluster LIMIT 20",
    "k12_card": "WITH m AS (SELECT cluster_id, unnest(members) AS text FROM clusters) SELECT cluster_id, count(*) AS size, CAST(sum(avg_monthly_searches) AS BIGINT) AS volume FROM m LEFT JOIN keywords USING (text) GROUP BY cluster_id",
    "x1_links": f"""WITH m AS (SELECT kw_id, list_distinct({_TOKS}) AS s FROM keywords WHERE text IS NOT NULL), t AS (SELECT kw_id, len(s) AS n, unnest(s) AS w FROM m),
p AS (SELECT a.kw_id AS x, b.kw_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM t a JOIN t b ON a.w = b.w AND a.kw_id <> b.kw_id GROUP BY ALL),
q AS (SELECT x, count(*) AS links FROM p WHERE common / (nx + ny - common) >= 0.5 GROUP BY x)
SELECT kw_id, coalesce(links, 0) AS links FROM m LEFT JOIN q ON kw_id = x""",
    "k13_medoids": """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT label, vec_id, round(sum((x.x - m.m) * (x.x - m.m)), 9) AS gap FROM x JOIN m USING (label, i) GROUP BY ALL)
SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap, vec_id) AS r FROM d) WHERE r = 1""",
    "j5_vector_links": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.id, count(b.id) AS links FROM v a LEFT JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.5 GROUP BY a.id""",
    "s8_cache_statistics": "SELECT provider, model, dim, count(*) AS n FROM emb GROUP BY ALL",
    "s9_alive": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY provider, model, req_dim, text ORDER BY cached_at DESC, vec_id DESC) AS r FROM emb WHERE text IS NOT NULL AND cached_at IS NOT NULL)
SELECT text, vec_id FROM n WHERE r = 1 AND epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(cached_at) <= 30::BIGINT * 86400 * 1000000""",
    "s9_keys": """SELECT page_id, sha256('{"path":' || to_json(coalesce(url, '')) || ',"payload":' || to_json(coalesce(engine, '')) || '}') AS key FROM pages""",
    "j12_hits": "SELECT DISTINCT term AS text FROM search_terms WHERE term IN (SELECT text FROM emb WHERE text IS NOT NULL)",
    "j12_misses": "SELECT DISTINCT term AS text FROM search_terms WHERE term IS NOT NULL AND term NOT IN (SELECT text FROM emb WHERE text IS NOT NULL)",
    "x3_distinct_in_order": "SELECT text, min(vec_id) AS first_id FROM emb WHERE text IS NOT NULL GROUP BY text",
    "g1_components": f"WITH RECURSIVE {_TOKEN_GROUPS} SELECT kw_id, root, component FROM grouped",
    "g3_token_groups": f"WITH RECURSIVE {_TOKEN_GROUPS} SELECT component AS cluster, {_ROLLED} FROM keywords JOIN grouped USING (kw_id) GROUP BY component HAVING count(*) >= 2",
    "k5_titles": f"WITH {_MEMBERS}, {_LABELS} SELECT cluster, array_to_string([upper(x[1:1]) || x[2:] for x in regexp_extract_all(label, '[\\p{{L}}]+|[^\\p{{L}}]+')], '') AS title FROM l",
    "k1_members": f"WITH {_MEMBERS} SELECT cluster, string_agg(text, '|' ORDER BY kw_id) AS members FROM h GROUP BY cluster",
    "g2_vector_groups": """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.5),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT id, coalesce(least(min(y), id), id) AS root FROM v LEFT JOIN r ON x = id GROUP BY id""",
    "g4_semantic": f"WITH RECURSIVE {_VECTORS} SELECT cluster, {_ROLLED}, string_agg(text, '|' ORDER BY kw_id) AS members FROM keywords JOIN grouped USING (kw_id) GROUP BY cluster",
    "g4_noise": f"WITH RECURSIVE {_VECTORS} SELECT kw_id FROM keywords WHERE text IS NOT NULL AND kw_id NOT IN (SELECT kw_id FROM grouped)",
}

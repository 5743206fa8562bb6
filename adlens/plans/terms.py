"""Queries over search terms and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.text import STOPWORDS, fold_content, fold_terms, keyword_tokens, ngrams, norm_keyword, phrase_count, slug, term_tokens, word_count
from adlens.operators.metrics import before_after, cost_ratios
from adlens.operators.ngram import NgramOptions, engagement, keyword_grams, negatives, ngram_table, normalize_schema, ranked, totals
from adlens.session import table

SUMS = ("cost", "clicks", "impressions", "conversions", "conv_value")


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summing can't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def n1_ngrams(spark: SparkSession, root: str) -> DataFrame:
    out = ngram_table(table(spark, root, "search_terms"), NgramOptions(), table(spark, root, "keywords"))
    return _rounded(out.select("ngram", "n", *SUMS, "blocked_search_terms", "blocked_keywords"))


def n3_totals(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(totals(table(spark, root, "search_terms")))


def n6_keyword_grams(spark: SparkSession, root: str) -> DataFrame:
    return keyword_grams(table(spark, root, "keywords"))


def n7_ratios(spark: SparkSession, root: str) -> DataFrame:
    out = ngram_table(table(spark, root, "search_terms"))
    return _rounded(out.select("ngram", "n", "ctr", "conv_rate", "cpa", "roas"), 8)


def n8_waste_target_cpa(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(ngram_table(table(spark, root, "search_terms"), NgramOptions(target_cpa=25.0)).select("ngram", "n", "nscore"))


def n8_waste_target_roas(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(ngram_table(table(spark, root, "search_terms"), NgramOptions(target_roas=2.0)).select("ngram", "n", "nscore"))


def n9_against_account(spark: SparkSession, root: str) -> DataFrame:
    out = ngram_table(table(spark, root, "search_terms"), NgramOptions(sizes=(1,)))
    return _rounded(out.select("ngram", "vs_avg_ctr", "vs_avg_conv_rate", "vs_avg_cpa", "vs_avg_roas"), 8)


def p_having(spark: SparkSession, root: str) -> DataFrame:
    out = ngram_table(table(spark, root, "search_terms"), NgramOptions(min_cost=50.0, min_terms=3))
    return _rounded(out.select("ngram", "n", "cost", "blocked_search_terms"))


def o1_top_waste(spark: SparkSession, root: str) -> DataFrame:
    """Top-100 report."""
    out = ngram_table(table(spark, root, "search_terms")).withColumn("nscore", F.round("nscore", 2))
    return ranked(out, 100).select("ngram", "n", "nscore")


def o3_negatives(spark: SparkSession, root: str) -> DataFrame:
    out = negatives(ngram_table(table(spark, root, "search_terms")))
    return _rounded(out.select("ngram", "n", "cost", "nscore"))


def n5_engagement(spark: SparkSession, root: str) -> DataFrame:
    side = table(spark, root, "keywords").select(F.col("text").alias("term"), F.col("avg_monthly_searches").cast("double").alias("sessions"), (F.col("avg_monthly_searches") * 0.25).alias("engaged_sessions"), (F.col("cpc_low") / 10).alias("bounce_rate"))
    return _rounded(engagement(table(spark, root, "search_terms"), side, NgramOptions(sizes=(1, 2))))


def f1_folded(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "keywords").select("kw_id", fold_terms(F.col("text")).alias("folded"))


def f2_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_terms").select("st_id", F.array_join(term_tokens(F.col("term")), "|").alias("tokens"))


def f3_ngrams(spark: SparkSession, root: str) -> DataFrame:
    grams = table(spark, root, "keywords").select("kw_id", F.posexplode(ngrams(term_tokens(F.col("text")), (2,))).alias("pos", "g"))
    return grams.select("kw_id", "pos", F.col("g.ngram").alias("ngram"))


def f5_word_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


def f7_phrase_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", phrase_count(F.lit("search term"), fold_content(F.col("text"))).alias("hits"))


def f8_keyword_norm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "keywords").select("kw_id", norm_keyword(F.col("text")).alias("norm"), F.array_join(keyword_tokens(F.col("text")), "|").alias("tokens"))


def f19_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "keywords").select("kw_id", slug(F.col("text")).alias("slug"))


def _periods(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_terms").filter(F.col("campaign").isNotNull() & F.col("seen_at").isNotNull())
    month = F.date_format("seen_at", "yyyy-MM")
    return rows.select(F.col("campaign").alias("segment"), month.alias("period"), "cost", F.col("conv_value").alias("revenue"), "clicks")


def j8_before_after(spark: SparkSession, root: str) -> DataFrame:
    out = before_after(_periods(spark, root), "2024-04", "2024-05")
    return _rounded(out.select("segment", "cost_before", "cost_after", "clicks_before", "clicks_after", "elasticity", "marginal_ers", "target_roas", "ok"))


def f15_ratios(spark: SparkSession, root: str) -> DataFrame:
    sums = _periods(spark, root).groupBy("segment", "period").agg(F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"))
    return _rounded(sums.select("segment", "period", *cost_ratios(F.col("cost"), F.col("revenue"))), 8)


def p1_aliases(spark: SparkSession, root: str) -> DataFrame:
    renamed = table(spark, root, "search_terms").withColumnRenamed("term", "search_term").withColumnRenamed("impressions", "impr").withColumnRenamed("conv_value", "value")
    return normalize_schema(renamed).groupBy("term").agg(F.count("*").alias("rows"), F.round(F.sum("impressions"), 4).alias("impressions"), F.round(F.sum("conv_value"), 4).alias("conv_value"))


QUERIES = {
    "n1_ngrams": n1_ngrams, "n3_totals": n3_totals, "n5_engagement": n5_engagement, "n6_keyword_grams": n6_keyword_grams, "n7_ratios": n7_ratios, "n8_waste_target_cpa": n8_waste_target_cpa, "n8_waste_target_roas": n8_waste_target_roas,
    "n9_against_account": n9_against_account, "having_cost_terms": p_having, "o1_top_waste": o1_top_waste, "o3_negatives": o3_negatives, "f1_folded": f1_folded, "f2_tokens": f2_tokens, "f3_ngrams": f3_ngrams, "f5_word_counts": f5_word_counts,
    "f7_phrase_counts": f7_phrase_counts, "f8_keyword_norm": f8_keyword_norm, "f19_slugs": f19_slugs, "j8_before_after": j8_before_after, "f15_ratios": f15_ratios, "aliases": p1_aliases,
}

# --- SQL twins -------------------------------------------------------------------------------------------------------

_FOLD = "lower(strip_accents(replace(replace(replace(replace(replace(replace(translate(coalesce({0}, ''), 'łŁđĐøØð', 'lLdDoOd'), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'ae'), 'œ', 'oe'), 'Œ', 'oe'), 'þ', 'th')))"
_TOKENS = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda t: t <> '')"
STOP_LIST = _STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
FOLDED_TOKENS = _TOKENS.format(_FOLD.format("term"))


def _grams(sizes: str, source: str, tokens: str = "toks") -> str:
    return f"""SELECT DISTINCT {source}, s.n, array_to_string(list_slice({tokens}, p.i, p.i + s.n - 1), ' ') AS ngram
 FROM base, (SELECT unnest({sizes}) AS n) s, (SELECT unnest(range(1, 65)) AS i) p WHERE p.i + s.n - 1 <= len({tokens})"""


def _ngram_sql(final: str, sizes: str = "[1, 2, 3]", having: str = "") -> str:
    return f"""
WITH facts AS (SELECT term, coalesce(cost, 0) AS cost, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions,
  coalesce(conversions, 0) AS conversions, coalesce(conv_value, 0) AS conv_value FROM search_terms WHERE trim(coalesce(term, '')) <> ''),
per_term AS (SELECT term, sum(cost) AS cost, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(conversions) AS conversions, sum(conv_value) AS conv_value, count(*) AS n_rows FROM facts GROUP BY term),
base AS (SELECT *, {_TOKENS.format(_FOLD.format('term'))} AS toks FROM per_term),
grams AS ({_grams(sizes, 'term')}),
kept AS (SELECT * FROM grams WHERE len(list_filter(string_split(ngram, ' '), lambda t: NOT (t IN {_STOP} OR length(t) = 1))) > 0),
agg AS (SELECT k.ngram, k.n, sum(cost) AS cost, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(conversions) AS conversions, sum(conv_value) AS conv_value, count(*) AS blocked_search_terms
  FROM kept k JOIN per_term t USING (term) GROUP BY k.ngram, k.n {having or "HAVING sum(cost) >= 0"}),
account AS (SELECT sum(clicks) / nullif(sum(impressions), 0) AS ctr, sum(conversions) / nullif(sum(clicks), 0) AS conv_rate, sum(cost) / nullif(sum(conversions), 0) AS cpa, sum(conv_value) / nullif(sum(cost), 0) AS roas FROM facts)
{final}"""


_R = "round({0}, 4) AS {0}"
_SUMS = ", ".join(_R.format(c) for c in SUMS)
_KW_GRAMS = f"""kbase AS (SELECT kw_id, {_TOKENS.format(_FOLD.format('text'))} AS toks FROM keywords),
kgrams AS (SELECT DISTINCT kw_id, s.n, array_to_string(list_slice(toks, p.i, p.i + s.n - 1), ' ') AS ngram FROM kbase, (SELECT unnest([1, 2, 3]) AS n) s, (SELECT unnest(range(1, 65)) AS i) p WHERE p.i + s.n - 1 <= len(toks)),
kw AS (SELECT ngram, n, count(*) AS blocked_keywords FROM kgrams GROUP BY ngram, n)"""
_DEFAULT_WASTE = "CASE WHEN conversions = 0 THEN cost ELSE cost - conv_value END"

SQL = {
    "n1_ngrams": _ngram_sql(f"SELECT ngram, n, {_SUMS}, blocked_search_terms, coalesce(blocked_keywords, 0) AS blocked_keywords FROM agg LEFT JOIN kw USING (ngram, n)").replace("account AS", f"{_KW_GRAMS},\naccount AS"),
    "n3_totals": f"""
WITH f AS (SELECT *, trim(coalesce(term, '')) <> '' AS held FROM search_terms),
s AS (SELECT {', '.join(f"coalesce(sum(CASE WHEN held THEN {c} END), 0) AS {c}" for c in SUMS)}, count(*) AS terms FROM f)
SELECT {_SUMS}, terms, round(clicks / nullif(impressions, 0), 4) AS ctr, round(conversions / nullif(clicks, 0), 4) AS conv_rate, round(cost / nullif(conversions, 0), 4) AS cpa, round(conv_value / nullif(cost, 0), 4) AS roas FROM s""",
    "n6_keyword_grams": f"WITH {_KW_GRAMS} SELECT * FROM kw",
    "n7_ratios": _ngram_sql("SELECT ngram, n, round(clicks / nullif(impressions, 0), 8) AS ctr, round(conversions / nullif(clicks, 0), 8) AS conv_rate, round(cost / nullif(conversions, 0), 8) AS cpa, round(conv_value / nullif(cost, 0), 8) AS roas FROM agg"),
    "n8_waste_target_cpa": _ngram_sql("SELECT ngram, n, round(cost - conversions * 25.0::DOUBLE, 4) AS nscore FROM agg"),
    "n8_waste_target_roas": _ngram_sql("SELECT ngram, n, round(cost - conv_value / 2.0::DOUBLE, 4) AS nscore FROM agg"),
    "n9_against_account": _ngram_sql(
        """SELECT ngram, round(agg.clicks / nullif(agg.impressions, 0) / nullif(account.ctr, 0) - 1, 8) AS vs_avg_ctr, round(agg.conversions / nullif(agg.clicks, 0) / nullif(account.conv_rate, 0) - 1, 8) AS vs_avg_conv_rate,
 round(-(agg.cost / nullif(agg.conversions, 0) / nullif(account.cpa, 0) - 1), 8) AS vs_avg_cpa, round(agg.conv_value / nullif(agg.cost, 0) / nullif(account.roas, 0) - 1, 8) AS vs_avg_roas FROM agg, account""",
        "[1]",
    ),
    "having_cost_terms": _ngram_sql("SELECT ngram, n, round(cost, 4) AS cost, blocked_search_terms FROM agg", having="HAVING sum(cost) >= 50 AND count(*) >= 3"),
    "o1_top_waste": _ngram_sql(f"SELECT ngram, n, round({_DEFAULT_WASTE}, 2) AS nscore FROM agg ORDER BY nscore DESC, ngram, n LIMIT 100"),
    "o3_negatives": _ngram_sql(f"SELECT ngram, n, round(cost, 4) AS cost, round({_DEFAULT_WASTE}, 4) AS nscore FROM agg WHERE round({_DEFAULT_WASTE}, 2) > 0 AND round(conversions, 2) = 0"),
    "n5_engagement": _ngram_sql(
        """, side AS (SELECT text AS term, CAST(avg_monthly_searches AS DOUBLE) AS s, avg_monthly_searches * 0.25 AS e, cpc_low / 10 AS b FROM keywords),
g AS (SELECT k.ngram, k.n, sum(coalesce(s, 0) * n_rows) AS sessions, sum(coalesce(e, 0) * n_rows) AS engaged_sessions, sum(b * coalesce(s, 0) * n_rows) AS bounces, sum(CASE WHEN b IS NOT NULL THEN coalesce(s, 0) * n_rows END) AS rated
 FROM kept k JOIN per_term USING (term) JOIN side USING (term) GROUP BY k.ngram, k.n)
SELECT ngram, n, round(sessions, 4) AS sessions, round(engaged_sessions, 4) AS engaged_sessions, round(engaged_sessions / nullif(sessions, 0), 4) AS engagement_rate, round(bounces / nullif(rated, 0), 4) AS bounce_rate FROM g""",
        "[1, 2]",
    ),
    "f1_folded": f"SELECT kw_id, {_FOLD.format('text')} AS folded FROM keywords",
    "f2_tokens": f"SELECT st_id, array_to_string({_TOKENS.format(_FOLD.format('term'))}, '|') AS tokens FROM search_terms",
    "f3_ngrams": f"WITH base AS (SELECT kw_id, {_TOKENS.format(_FOLD.format('text'))} AS toks FROM keywords) SELECT kw_id, CAST(p.i - 1 AS INTEGER) AS pos, array_to_string(list_slice(toks, p.i, p.i + 1), ' ') AS ngram FROM base, (SELECT unnest(range(1, 65)) AS i) p WHERE p.i + 1 <= len(toks)",
    "f5_word_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+')) AS INTEGER) AS words FROM documents",
    "f7_phrase_counts": rf"SELECT doc_id, CAST(len(regexp_extract_all({_FOLD.format('text')}, '\bsearch\s+term\b')) AS INTEGER) AS hits FROM documents WHERE text IS NOT NULL",
    "f8_keyword_norm": r"""
WITH n AS (SELECT kw_id, trim(regexp_replace(strip_accents(translate(lower(coalesce(text, '')), 'łđø', 'ldo')), '\s+', ' ', 'g')) AS norm FROM keywords)
SELECT kw_id, norm, array_to_string(regexp_extract_all(norm, '[\p{L}\p{N}]+'), '|') AS tokens FROM n""",
    "f19_slugs": "WITH s AS (SELECT kw_id, regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM keywords) SELECT kw_id, CASE WHEN slug = '' THEN 'item' ELSE slug END AS slug FROM s",
    "j8_before_after": """
WITH p AS (SELECT campaign AS segment, strftime(seen_at, '%Y-%m') AS period, cost, conv_value AS revenue, clicks FROM search_terms WHERE campaign IS NOT NULL AND seen_at IS NOT NULL),
b AS (SELECT segment, sum(CASE WHEN period = '2024-04' THEN cost END) AS cost_before, sum(CASE WHEN period = '2024-05' THEN cost END) AS cost_after, sum(CASE WHEN period = '2024-04' THEN clicks END) AS clicks_before,
 sum(CASE WHEN period = '2024-05' THEN clicks END) AS clicks_after, sum(CASE WHEN period = '2024-04' THEN revenue END) AS revenue_before, sum(CASE WHEN period = '2024-05' THEN revenue END) AS revenue_after
 FROM p WHERE period IN ('2024-04', '2024-05') GROUP BY segment),
c AS (SELECT *, cost_before / nullif(clicks_before, 0) AS cpc_b, cost_after / nullif(clicks_after, 0) AS cpc_a FROM b),
e AS (SELECT *, CASE WHEN cpc_a / nullif(cpc_b, 0) - 1 <> 0 THEN (clicks_after / nullif(clicks_before, 0) - 1) / (cpc_a / nullif(cpc_b, 0) - 1) END AS el, CASE WHEN revenue_after > 0 THEN cost_after / revenue_after END AS ers FROM c)
SELECT segment, round(cost_before, 4) AS cost_before, round(cost_after, 4) AS cost_after, round(clicks_before, 4) AS clicks_before, round(clicks_after, 4) AS clicks_after, round(el, 4) AS elasticity,
 round(ers * CASE WHEN el <> 0 THEN 1 + 1 / el END, 4) AS marginal_ers, round(CASE WHEN el <> 0 THEN 1 + 1 / el END, 4) AS target_roas,
 (cost_before IS NOT NULL AND cost_after IS NOT NULL AND clicks_before IS NOT NULL AND clicks_after IS NOT NULL AND revenue_before IS NOT NULL AND revenue_after IS NOT NULL AND el IS NOT NULL AND ers IS NOT NULL) AS ok FROM e""",
    "f15_ratios": """
WITH s AS (SELECT campaign AS segment, strftime(seen_at, '%Y-%m') AS period, sum(cost) AS cost, sum(conv_value) AS revenue FROM search_terms WHERE campaign IS NOT NULL AND seen_at IS NOT NULL GROUP BY 1, 2)
SELECT segment, period, round(CASE WHEN revenue > 0 THEN cost / revenue END, 8) AS ers, round(CASE WHEN cost > 0 THEN revenue / cost END, 8) AS roas, round(CASE WHEN cost > 0 THEN revenue / cost END - 1, 8) AS roi FROM s""",
    "aliases": "SELECT coalesce(term, '') AS term, count(*) AS rows, round(sum(coalesce(impressions, 0)), 4) AS impressions, round(sum(coalesce(conv_value, 0)), 4) AS conv_value FROM search_terms GROUP BY 1",
}

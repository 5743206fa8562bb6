"""Queries that run a stream over the files of a table until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.plans.terms import FOLDED_TOKENS, STOP_LIST
from adlens.streaming.page_changes import changes
from adlens.streaming.search_terms import drained, read_files, windowed_ngrams, windowed_sums


def stream_weekly_sums(spark: SparkSession, root: str) -> DataFrame:
    out = drained(windowed_sums(read_files(spark, f"{root}/search_terms.parquet"), watermark="400 days"))
    return out.select(F.date_format("starts_at", "yyyy-MM-dd").alias("week"), "campaign", "rows", F.round("cost", 4).alias("cost"), F.round("clicks", 4).alias("clicks"))


def stream_ngrams(spark: SparkSession, root: str) -> DataFrame:
    out = drained(windowed_ngrams(read_files(spark, f"{root}/search_terms.parquet"), watermark="400 days"))
    return out.groupBy("ngram").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("clicks"), 4).alias("clicks"))


def stream_page_changes(spark: SparkSession, root: str) -> DataFrame:
    return drained(changes(read_files(spark, f"{root}/snapshots.parquet")), "append").select("url", "fetched_at", "text_hash", "changed")


QUERIES = {"stream_weekly_sums": stream_weekly_sums, "stream_ngrams": stream_ngrams, "stream_page_changes": stream_page_changes}

SQL = {
    "stream_weekly_sums": """SELECT strftime(time_bucket(INTERVAL 7 DAY, seen_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, campaign, count(*) AS rows, round(sum(coalesce(cost, 0)), 4) AS cost, round(sum(coalesce(clicks, 0)), 4) AS clicks
FROM search_terms WHERE seen_at IS NOT NULL GROUP BY ALL""",
    "stream_page_changes": """SELECT url, fetched_at, sha256(text) AS text_hash, lag(sha256(text)) OVER w <> sha256(text) AS changed FROM snapshots WHERE text IS NOT NULL AND url IS NOT NULL AND fetched_at IS NOT NULL
WINDOW w AS (PARTITION BY url ORDER BY fetched_at, snap_id)""",
    "stream_ngrams": f"""WITH t AS (SELECT cost, clicks, unnest(list_distinct({FOLDED_TOKENS})) AS ngram FROM search_terms WHERE seen_at IS NOT NULL AND trim(coalesce(term, '')) <> '')
SELECT ngram, round(sum(coalesce(cost, 0)), 4) AS cost, round(sum(coalesce(clicks, 0)), 4) AS clicks FROM t WHERE length(ngram) > 1 AND ngram NOT IN {STOP_LIST} GROUP BY ngram""",
}

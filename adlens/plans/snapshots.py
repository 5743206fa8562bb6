"""Queries over full deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.operators.snapshot_diff import snapshot_changes
from adlens.session import table


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "snapshots"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": r"""
WITH base AS (
 SELECT delivery, fetched_at, snap_id,
  trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'), ' ') AS body,
  regexp_replace(url, '#.*$', '') AS bare
 FROM snapshots WHERE text IS NOT NULL AND url IS NOT NULL AND delivery IS NOT NULL),
parts AS (
 SELECT *, regexp_extract(bare, '^([^/?]*//[^/?]*)', 1) AS head,
  regexp_replace(regexp_extract(bare, '^(?:[^/?]*//[^/?]*)?([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS query
 FROM base),
keyed AS (
 SELECT delivery, lower(head) || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url, body,
  row_number() OVER (PARTITION BY delivery, lower(head) || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
                     ORDER BY fetched_at DESC NULLS LAST, snap_id DESC) AS rn
 FROM parts),
latest AS (SELECT delivery, url, body FROM keyed WHERE rn = 1),
held AS (SELECT DISTINCT delivery FROM latest),
pairs AS (SELECT a.delivery FROM held a JOIN held b ON b.delivery = a.delivery - 1),
new AS (SELECT l.* FROM latest l JOIN pairs USING (delivery)),
old AS (SELECT l.delivery + 1 AS delivery, l.url, l.body FROM latest l JOIN pairs p ON p.delivery = l.delivery + 1)
SELECT CAST(coalesce(new.delivery, old.delivery) AS INTEGER) AS delivery, coalesce(new.url, old.url) AS url,
 CASE WHEN old.url IS NULL THEN 'added' WHEN new.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new FULL OUTER JOIN old ON new.delivery = old.delivery AND new.url = old.url
WHERE old.url IS NULL OR new.url IS NULL OR new.body <> old.body
"""
}

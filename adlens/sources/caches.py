"""Keyed caches as tables: newest entry per key, expiry, hits and misses, statistics.

Defined cases: null keys are never hit; an entry exactly as old as ``ttl`` is a hit; no ``ttl`` never expires; of entries of equal time
the one with the greatest tie-break column counts; requests are distinct per text and keep their first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(path: Column, payload: Column) -> Column:
    """Key of a request: its path and payload (canonical JSON text); the method takes no part."""
    return F.sha2(F.to_json(F.struct(path.alias("path"), payload.alias("payload"))), 256)


def newest(entries: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest entry per key; partial maxima are taken before the shuffle, so a hot key is one row per task."""
    rest = [c for c in entries.columns if c not in keys]
    best = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("e"))
    return best.select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def alive(entries: DataFrame, at: str, now: Column, ttl_seconds: float | None) -> DataFrame:
    """Entries not older than ``ttl_seconds`` at ``now``."""
    if ttl_seconds is None:
        return entries
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return entries.filter(age <= ttl_seconds)


def split_requests(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of distinct requests, by semi and anti join on the key."""
    distinct = requests.filter(F.col(key).isNotNull()).select(key).distinct()
    held = cache.select(key).filter(F.col(key).isNotNull()).distinct()
    return distinct.join(held, key, "left_semi"), distinct.join(held, key, "left_anti")


def statistics(cache: DataFrame, by: list[str]) -> DataFrame:
    return cache.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)

"""Versions of pages over time: change flags, line diffs, listings.

Defined cases: versions without text are left out; the first version of a key has no flag and is a baseline; versions are
ordered by time, ties by the tie-break column; null times come first. A key's versions are compared by a window that
carries hashes only; texts are brought together for changed neighbours alone.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.sources.pages import domain_slug


def flagged(versions: DataFrame, tie: str = "snap_id", scope: str = "url") -> DataFrame:
    """``versions`` (url, fetched_at, text, tie) with hash, previous version and ``changed`` (null on the first).

    ``scope`` says what a version is compared with: the one before of its ``url`` or of its whole ``domain``.
    """
    if scope not in ("url", "domain"):
        raise ValueError(f"unknown scope: {scope}")
    rows = versions.filter("text IS NOT NULL AND url IS NOT NULL").select(tie, "url", "fetched_at", F.sha2("text", 256).alias("text_hash"))
    order = Window.partitionBy("url" if scope == "url" else domain_slug(F.col("url"))).orderBy("fetched_at", tie)
    before = F.lag("text_hash").over(order)
    return rows.select("*", F.lag(tie).over(order).alias("previous"), (before != F.col("text_hash")).alias("changed"))


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("diff", T.StringType())]))
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Unified line diff with its counts of added and removed lines; lines that look like file headers don't count."""
    out = []
    for a, b in zip(old, new):
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
        plus = sum(x.startswith("+") and not x.startswith("+++") for x in lines)
        minus = sum(x.startswith("-") and not x.startswith("---") for x in lines)
        out.append((plus, minus, "\n".join(lines)))
    return pd.DataFrame(out, columns=["added", "removed", "diff"])


def diffs(versions: DataFrame, tie: str = "snap_id", limit: int | None = 8000) -> DataFrame:
    """(tie, previous, url, added, removed, diff) of every changed version; the shown diff is cut at ``limit`` characters, counts are whole."""
    changed = flagged(versions, tie).filter("changed").select(tie, "previous", "url")
    texts = versions.select(tie, "text")
    both = changed.join(texts.withColumnRenamed("text", "new"), tie).join(texts.select(F.col(tie).alias("previous"), F.col("text").alias("old")), "previous")
    out = both.select(tie, "previous", "url", line_diff("old", "new").alias("d")).select(tie, "previous", "url", "d.added", "d.removed", "d.diff")
    if limit:
        out = out.withColumn("diff", F.when(F.length("diff") > limit, F.concat(F.substring("diff", 1, limit), F.lit("\n... (cut)"))).otherwise(F.col("diff")))
    return out


def listed(versions: DataFrame) -> DataFrame:
    """(url, versions, texts, first_at, last_at) of every url."""
    rows = versions.filter("text IS NOT NULL AND url IS NOT NULL")
    return rows.groupBy("url").agg(F.count("*").alias("versions"), F.count_distinct(F.sha2("text", 256)).alias("texts"), F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at"))

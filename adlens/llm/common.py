"""Shared input shapes: the text sources as (src, rec_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.session import table


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(src, rec_id, text, status, url) of pages (html), snapshots and documents, null texts left out."""
    no_status = F.lit(None).cast("int").alias("status")
    pages = table(spark, root, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("rec_id"), F.col("html").alias("text"), "status", "url")
    snaps = table(spark, root, "snapshots").select(F.lit("snapshots").alias("src"), F.col("snap_id").alias("rec_id"), "text", no_status, "url")
    docs = table(spark, root, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text", no_status, "url")
    return pages.unionByName(snaps).unionByName(docs).filter(F.col("text").isNotNull())

"""Search terms as a stream: windowed sums with late data, duplicates dropped within the watermark.

Defined cases: rows without event time are left out; rows later than the watermark are dropped by the engine, so choose it
by how late rows are loaded; null metrics count as 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators.ngram import NgramOptions, normalize_schema
from adlens.functions.text import STOPWORDS, is_function_gram, ngrams, term_tokens
from adlens.session import scratch_dir


def read_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of the Parquet files at ``path``, a folder or a single file."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is accepted, too
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def windowed_sums(stream: DataFrame, window: str = "7 days", watermark: str = "60 days", key: str | None = None) -> DataFrame:
    """(starts_at, campaign, rows, cost, clicks) per event-time window; with ``key`` equal keys count once within the watermark."""
    rows = stream.filter("seen_at IS NOT NULL").withColumn("at", F.col("seen_at").cast("timestamp")).withWatermark("at", watermark)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key])
    sums = rows.groupBy(F.window("at", window).alias("w"), "campaign").agg(F.count("*").alias("rows"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.sum(F.coalesce("clicks", F.lit(0.0))).alias("clicks"))
    return sums.select(F.col("w.start").alias("starts_at"), "campaign", "rows", "cost", "clicks")


def windowed_ngrams(stream: DataFrame, options: NgramOptions = NgramOptions(sizes=(1,)), window: str = "30 days", watermark: str = "60 days") -> DataFrame:
    """(starts_at, ngram, n, cost, clicks) per event-time window."""
    rows = stream.filter("seen_at IS NOT NULL").withColumn("at", F.col("seen_at").cast("timestamp")).withWatermark("at", watermark)
    facts = normalize_schema(rows).columns
    named = rows.select("at", F.coalesce("term", F.lit("")).alias("term"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in facts if c in ("cost", "clicks")])
    grams = named.filter(F.trim("term") != "").select("at", "cost", "clicks", F.explode(F.array_distinct(ngrams(term_tokens(F.col("term")), options.sizes))).alias("g"))
    kept = grams.filter(~is_function_gram(F.col("g.ngram"), STOPWORDS))
    sums = kept.groupBy(F.window("at", window).alias("w"), F.col("g.ngram").alias("ngram"), F.col("g.n").alias("n")).agg(F.sum("cost").alias("cost"), F.sum("clicks").alias("clicks"))
    return sums.select(F.col("w.start").alias("starts_at"), "ngram", "n", "cost", "clicks")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is available now and return its last complete result (or, for ``append``, all rows) as a table."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/adlens-stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        # Batches go to numbered folders: a repeated batch replaces its own.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == last) if last is not None else rows
    return rows.drop("batch")

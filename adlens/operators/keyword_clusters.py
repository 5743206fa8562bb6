"""Groups of keywords with their rollups.

Defined cases: keywords without text are left out; null metrics are ignored by sums and means, which are null where no
member has the metric; ties go to the smaller kw_id, for labels to the alphabetically first; equal keywords are members each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import keyword_tokens, ngrams
from adlens.operators.graph import components, ranked_components
from adlens.operators.similarity import blocked_vector_links, lexical_ratio, set_links, token_sets, token_sort_ratio
from adlens.operators.text_groups import group_links
from adlens.operators.whitening import apply_background, whitened
from adlens.session import written

#: Default least similarity of each method.
THRESHOLDS = {"tokens": 0.5, "lexical": 0.5, "fuzzy": 0.7}
THRESHOLD_SEMANTIC = 0.8


def competition_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def keyword_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Keyword rows from texts or dictionaries: a text is a row without metrics; a dictionary without a text is an error."""
    names = [f.split()[0] for f in _KEYWORD.split(", ")]
    out = []
    for i, row in enumerate(rows):
        own = {"text": row} if isinstance(row, str) else dict(row)
        if not own.get("text"):
            raise ValueError(f"keyword {i} has no text")
        out.append(tuple(own.get(n, i if n == "kw_id" else None) for n in names))
    return spark.createDataFrame(out, _KEYWORD)


_KEYWORD = "kw_id bigint, text string, avg_monthly_searches bigint, cpc_low double, cpc_high double, competition string"


def resolve_method(method: str, has_vectors: bool) -> str:
    """``auto`` is semantic where vectors are at hand, else fuzzy."""
    if method == "auto":
        return "semantic" if has_vectors else "fuzzy"
    if method not in (*THRESHOLDS, "semantic"):
        raise ValueError(f"unknown method: {method}")
    return method


def keyword_clusters(keywords: DataFrame, method: str = "auto", least: float | None = None, min_size: int = 2, vectors: DataFrame | None = None, whitening: str = "batch", background: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """((rollup of every cluster, with label), noise (kw_id)) by any method; clusters are named by their smallest kw_id.

    ``semantic``: ``vectors`` (text, vec) of the keywords are transformed by a saved ``background`` (mean, matrix), whitened as a
    batch (``whitening`` 'batch') or left as they are ('none'), and linked from a cosine of ``least``. Keywords in groups below
    ``min_size``, and those without a vector, are noise. A text's vector serves all keywords with that text.
    """
    method = resolve_method(method, vectors is not None)
    rows = keywords.filter("text IS NOT NULL")
    if method == "semantic":
        if vectors is None:
            raise ValueError("the semantic method needs vectors")
        own = rows.select("kw_id", "text").join(vectors.filter("text IS NOT NULL AND vec IS NOT NULL").groupBy("text").agg(F.first("vec").alias("vec")), "text").select(F.col("kw_id").alias("id"), "vec")
        own = written(own)
        dim = own.agg(F.max(F.size("vec"))).first()[0] or 0
        if background is not None:
            own = apply_background(own, dim, *background)
        elif whitening == "batch":
            own = whitened(own, dim)
        elif whitening != "none":
            raise ValueError(f"unknown whitening: {whitening}")
        labels_ = vector_clusters(own, THRESHOLD_SEMANTIC if least is None else least, 1)[0].select(F.col("id").alias("kw_id"), F.col("root").alias("cluster"))
    else:
        labels_ = cluster_ids(rows, method, least).select("kw_id", F.col("root").alias("cluster"))
    members = written(rows.join(labels_, "kw_id"))
    large = members.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("cluster")
    kept = members.join(large, "cluster", "left_semi")
    named = distinct_labels(labels(kept), kept)
    noise = rows.select("kw_id").join(kept.select("kw_id"), "kw_id", "left_anti")
    return rollup(kept, members=True).join(named, "cluster", "left"), noise


def two_stage_clusters(keywords: DataFrame, vectors: DataFrame, least: float | None = None, least_fuzzy: float | None = None, min_size: int = 2, whitening: str = "batch", background: tuple | None = None) -> DataFrame:
    """Semantic clusters, and fuzzy ones of the keywords these leave as noise: the rollups with ``stage``."""
    semantic, noise = keyword_clusters(keywords, "semantic", least, min_size, vectors, whitening, background)
    rest = written(keywords.join(noise, "kw_id", "left_semi"))
    fuzzy, _ = keyword_clusters(rest, "fuzzy", least_fuzzy, min_size)
    return semantic.withColumn("stage", F.lit("semantic")).unionByName(fuzzy.withColumn("stage", F.lit("fuzzy")))


def cluster_ids(keywords: DataFrame, method: str = "tokens", least: float | None = None) -> DataFrame:
    """(kw_id, root, component): connected groups of similar keywords, single ones included.

    ``tokens`` links by Jaccard similarity of token sets and scales; ``lexical`` and ``fuzzy`` compare texts with a hub, and those apart
    from the largest component with all others.
    """
    if method not in THRESHOLDS:
        raise ValueError(f"unknown method: {method}")
    least = THRESHOLDS[method] if least is None else least
    texts = keywords.filter("text IS NOT NULL").select(F.col("kw_id").alias("id"), "text")
    if method == "tokens":
        sets, members = token_sets(texts)
        links = set_links(sets, least).select("a", "b")
        grouped = members.join(components(links).withColumnRenamed("node", "set_id"), "set_id", "left").select("id", F.coalesce("root", "set_id").alias("mark"))
        roots = grouped.groupBy("mark").agg(F.min("id").alias("root"))
        labels = grouped.join(roots, "mark").select(F.col("id").alias("kw_id"), "root")
    else:
        links = group_links(texts, lexical_ratio if method == "lexical" else token_sort_ratio, least)
        found = components(links).select(F.col("node").alias("id"), "root")
        labels = texts.join(found, "id", "left").select(F.col("id").alias("kw_id"), F.coalesce("root", "id").alias("root"))
    return ranked_components(written(labels), "kw_id")


def vector_clusters(vectors: DataFrame, least: float = 0.8, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """((id, root, component), noise (id)) of connected groups of vectors (id, vec) with a cosine of at least ``least``.

    Components are numbered over the groups of at least ``min_size``; ids of smaller ones and of unusable vectors are noise.
    """
    ids = vectors.select("id").distinct()
    found = components(blocked_vector_links(vectors, least, forest=True).select("a", "b"))
    labels = written(ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    large = labels.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("root")
    kept = ranked_components(written(labels.join(large, "root", "left_semi")), "id")
    return kept, labels.join(large, "root", "left_anti").select("id")


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Every run of letters with a capital first letter and the rest small."""
    return pd.Series([None if t is None else t.title() for t in text], dtype=object)


def rollup(rows: DataFrame, members: bool = False) -> DataFrame:
    """One row per cluster of (cluster, kw_id, text, avg_monthly_searches, cpc_low, cpc_high, competition).

    With ``members`` also the texts of all members by kw_id: a list as long as the cluster, so only for clusters that fit a row.
    """
    v = F.col("avg_monthly_searches")
    by_volume = F.max_by("text", F.when(v.isNotNull(), F.struct(v, -F.col("kw_id"))))
    by_length = F.min_by("text", F.struct(F.length("text"), "kw_id"))
    named = F.when(F.coalesce(F.col("competition"), F.lit("")) != "", F.struct(competition_rank(F.col("competition")), -F.col("kw_id")))
    listed = [F.transform(F.array_sort(F.collect_list(F.struct("kw_id", "text"))), lambda m: m["text"]).alias("members")] if members else []
    return rows.filter("text IS NOT NULL").groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.sum(v).alias("total_volume"),
        F.avg((F.col("cpc_low") + F.col("cpc_high")) / 2).alias("avg_cpc"),
        F.max_by("competition", named).alias("dominant_competition"),
        F.coalesce(by_volume, by_length).alias("representative_keyword"),
        *listed,
    )


def labels(members: DataFrame) -> DataFrame:
    """(cluster, label): the longest n-gram that two or more members share (trigram, bigram), else the most frequent word."""
    grams = members.filter("text IS NOT NULL").select("cluster", "kw_id", F.explode(F.array_distinct(ngrams(keyword_tokens(F.col("text")), (1, 2, 3)))).alias("g"))
    counted = grams.groupBy("cluster", "g.n", "g.ngram").agg(F.count("*").alias("held")).filter((F.col("held") >= 2) | (F.col("n") == 1))
    best = Window.partitionBy("cluster").orderBy(F.desc("n"), F.desc("held"), "ngram")
    return counted.withColumn("r", F.row_number().over(best)).filter("r = 1").select("cluster", F.col("ngram").alias("label"))


def distinct_labels(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """Labels that several clusters share get the cluster's most frequent word that the label lacks."""
    shared = labelled.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    clash = labelled.join(shared, "label", "left_semi")
    words = members.join(clash, "cluster").select("cluster", "label", "kw_id", F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("word")).filter(~F.array_contains(F.split("label", " "), F.col("word")))
    counted = words.groupBy("cluster", "word").agg(F.count("*").alias("held"))
    extra = counted.groupBy("cluster").agg(F.min_by("word", F.struct(-F.col("held"), "word")).alias("extra"))
    return labelled.join(extra, "cluster", "left").select("cluster", F.concat_ws(" ", "label", "extra").alias("label"))


def medoids(vectors: DataFrame) -> DataFrame:
    """(label, vec_id): the member nearest to its group's mean, of (label, vec_id, vec); means are summed per task before the shuffle."""
    means = vectors.groupBy("label").agg(Summarizer.mean(array_to_vector("vec")).alias("mean")).select("label", vector_to_array("mean").alias("mean"))
    gap = F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return vectors.join(means, "label").groupBy("label").agg(F.min_by("vec_id", F.struct(F.round(gap, 9), "vec_id")).alias("vec_id"))

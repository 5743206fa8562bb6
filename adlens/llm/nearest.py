"""The most similar vectors of every vector: randomly rotated one-bit codes with error bounds, reranking.

Candidates are reranked by their 16-bit vectors in their cell, and by the stored vectors where rounding could decide who is among the best.

Defined cases: unusable vectors (see ``vectors.usable``) take no part; a vector alone in its space has no neighbours; equal
vectors are each other's nearest, and ties are broken by the smaller vec_id; groups of equal vectors are searched once and
their members get the same neighbours, so a group of any size costs a few rows per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.vectors import SAMPLE, OneBitCodes, decoded, indexed, unit, usable
from adlens.session import written

NEAR = 6
#: Most by which rounding to 16 bits moves a cosine, and candidates beyond the k best that are kept until the stored vectors have decided.
ROUNDED, SPARE = 5e-5, 2


def _search(least: float, k: int):
    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key")
        keys, out = part["key"].to_numpy(), []
        if len(keys) > 1:
            for i, j, s in OneBitCodes(decoded(part["code"].tolist())).nearest(least, k):
                order = np.lexsort((keys[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
                top = rank < k
                out.append(pd.DataFrame({"a": keys[i[top]], "b": keys[j[top]], "score": s[top]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "score": []})

    return search


def _settled(best: DataFrame, rows: DataFrame, least: float, k: int) -> DataFrame:
    """``best`` (a, b, score, r) with scores from the stored vectors where the rounding of the codes could decide."""
    last = Window.partitionBy("a")
    edge = F.max(F.when(F.col("r") == k, F.col("score"))).over(last)
    beyond = F.max(F.when(F.col("r") == k + 1, F.col("score"))).over(last)
    doubt = (F.abs(F.col("score") - least) <= ROUNDED) | ((edge - beyond <= ROUNDED) & (F.abs(F.col("score") - edge) <= ROUNDED))
    marked = best.withColumn("doubt", F.coalesce(doubt, F.lit(False)))
    pairs = written(marked.filter("doubt").select("a", "b"))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    stored = written(rows.select("key", "vec").join(keys, "key", "left_semi").groupBy("key").agg(F.first("vec").alias("vec")))
    both = pairs.join(stored.select(F.col("key").alias("a"), F.col("vec").alias("x")), "a").join(stored.select(F.col("key").alias("b"), F.col("vec").alias("y")), "b")

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            s = [float(unit([x])[0] @ unit([y])[0]) for x, y in zip(part["x"], part["y"])]
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "exact": pd.Series(s, dtype=float)})

    sure = both.mapInPandas(exact, "a bigint, b bigint, exact double")
    return best.join(sure, ["a", "b"], "left").select("a", "b", F.coalesce("exact", "score").alias("score"))


def neighbours(emb: DataFrame, k: int = 5, least: float = 0.8, near: int = NEAR, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, other_id, score, rank): the up to ``k`` other rows of the same space with the greatest cosine from ``least``."""
    rows = usable(emb)
    members = written(rows.select("space", "key", "vec_id"))
    found = indexed(rows, members, near, sample=sample).groupBy("space", "cell").applyInPandas(_search(least - ROUNDED, k + SPARE), "a bigint, b bigint, score double")
    best = found.groupBy("a", "b").agg(F.max("score").alias("score"))
    best = written(best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("r") <= k + SPARE))
    best = _settled(best, rows, least, k).filter(F.col("score") >= least)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("r") <= k).drop("r")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    copies = first.join(first.filter("r = 2").select("key"), "key", "left_semi").select(F.col("key").alias("a"), F.col("vec_id").alias("other_id"), F.lit(1.0).alias("score"))
    others = best.join(first.select(F.col("key").alias("b"), F.col("vec_id").alias("other_id")), "b").select("a", "other_id", "score").unionByName(copies)
    full = members.withColumnRenamed("key", "a").join(others, "a").filter(F.col("vec_id") != F.col("other_id"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "other_id"))
    return full.select("vec_id", "other_id", "score", rank.alias("rank")).filter(F.col("rank") <= k)


def near_pairs(emb: DataFrame, k: int = 5, least: float = 0.8, near: int = NEAR) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: one is among the other's ``k`` nearest, with a cosine of at least ``least``."""
    found = neighbours(emb, k, least, near)
    return found.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()

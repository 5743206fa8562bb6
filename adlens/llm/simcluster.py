"""Groups of mutually similar vectors: power-iteration spectral clustering over sparse affinities.

The affinity graph joins vectors of one space whose cosine reaches ``least``. It is kept sparse: inside every cell of the index
a vector keeps its ``STRONGEST`` strongest links and the one to its best linked neighbour, and links that hold parts of the
cell's graph together; all others say nothing new. The degree-normalised affinity (with each vector's own degree as a loop) is
applied to several start vectors drawn from key hashes, iterated together as columns of one distributed table. k-means clusters
the embedding, started from its occupied cells (side ``TOLERANCE``, so that k has a bound whatever the number of rows).

Linked vectors that fall into one cluster become one node, with the affinities of its members added up. As long as affinities
are left between nodes, the next level iterates the graph of the nodes, with fresh start vectors and, the nodes being fewer,
cells of twice the side: a group that is well connected is one node after the first level, a long chain takes some more.
Where a level joins nothing, the next one iterates twice as long. So a group is what the embedding holds together at some level, vectors that no affinity joins never
share a group even where they share a cell, and with an embedding that tells nothing apart from anything no group is formed. Members
are ranked by internal affinity, the sum of their cosines with all members, which equals the product with the sum of their unit vectors.

Defined cases: unusable vectors (see ``vectors.usable``) take no part; a vector like no other is no group; equal vectors
are one vector for the iteration and all members of the result; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.vectors import decoded, indexed, unit, usable
from adlens.session import written

#: Cells a vector is placed in and rows a cell is home to: groups hold together by links near the threshold, so in more cells than
#: for the nearest vectors.
NEAR, HOME = 7, 64
COLUMNS, TOLERANCE, STRONGEST = 3, 0.15, 2
#: Levels after which links that are left would mean an embedding that holds nothing together.
LEVELS = 40


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def sparse_links(n: int, i: np.ndarray, j: np.ndarray, s: np.ndarray, strongest: int = STRONGEST) -> np.ndarray:
    """Which of the links (i, j, s) of n rows to keep: connected rows stay connected, a row keeps a few."""
    keep = np.zeros(len(i), bool)
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    at = np.arange(len(i), dtype=np.int64)

    def best(score_i: np.ndarray, score_j: np.ndarray) -> None:
        """Keep each row's link with the greatest score: of row i's link (i, j) that is ``score_i``."""
        ends, links, scores = np.r_[i, j], np.r_[at, at], np.r_[score_i, score_j]
        order = np.lexsort((links, -scores, ends))
        first = np.r_[True, ends[order][1:] != ends[order][:-1]]
        keep[links[order][first]] = True

    best(degree[j].astype(float), degree[i].astype(float))
    for _ in range(strongest):
        free = np.where(keep, -1.0, s)
        best(free, free)
    label = _connected(n, i[keep], j[keep])
    while len(apart := np.flatnonzero(label[i] != label[j])):  # one link for each pair of parts
        a, b = label[i[apart]], label[j[apart]]
        keep[apart[np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)[1]]] = True
        label = _connected(n, i[keep], j[keep])
    return keep


def close_pairs(x: np.ndarray, least: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product), i < j, of all pairs of unit rows with products from ``least``, by products of blocks of rows."""
    found = []
    for a in range(0, len(x), block):
        score = x[a : a + block] @ x[a:].T
        i, j = np.nonzero(score >= least)
        i, j = i[i < j], j[i < j]
        found.append((i + a, j + a, score[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _links(least: float):
    """Kept links of one cell in both directions: a, b, weight."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key").sort_values("key")
        keys = part["key"].to_numpy()
        i, j, s = close_pairs(decoded(part["code"].tolist()), least) if len(keys) > 1 else ((), (), ())
        if not len(i):
            return pd.DataFrame({"a": [], "b": [], "weight": []})
        keep = sparse_links(len(keys), i, j, s)
        a, b, s = keys[i[keep]], keys[j[keep]], s[keep]
        return pd.DataFrame({"a": np.r_[a, b], "b": np.r_[b, a], "weight": np.r_[s, s]})

    return links


def affinities(rows: DataFrame, keys: DataFrame, least: float, near: int = NEAR) -> DataFrame:
    """(a, b, weight), each link in both directions, over the distinct usable vectors ``rows``; ``keys`` are their space and key, written."""
    found = indexed(rows, keys, near, HOME).groupBy("space", "cell").applyInPandas(_links(least), "a bigint, b bigint, weight double")
    return found.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def power_iteration(links: DataFrame, rounds: int, seed: int = 0, columns: int = COLUMNS) -> DataFrame:
    """(key, v0, v1, ...): start vectors after ``rounds`` applications of the normalised affinity."""
    names = [f"v{i}" for i in range(columns)]
    start = [((F.pmod(F.xxhash64("key", F.lit(seed), F.lit(i)), F.lit(1_000_003))) / 1_000_003.0).alias(c) for i, c in enumerate(names)]
    # The loop has the weight of all other links, so that two linked vectors don't just change places.
    loops = links.groupBy("a").agg(F.sum("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")
    full = written(links.select("a", "b", "weight").unionByName(loops))
    values = full.select(F.col("a").alias("key")).distinct().select("key", *start)
    total = F.sum("weight")
    for r in range(rounds):
        held = full.join(values.withColumnRenamed("key", "b"), "b")
        values = held.groupBy(F.col("a").alias("key")).agg(*[(F.sum(F.col(c) * F.col("weight")) / total).alias(c) for c in names])
        if r % 4 == 3:
            values = written(values)
    return values


def kmeans(values: DataFrame, tolerance: float = TOLERANCE, rounds: int = 2) -> DataFrame:
    """(key, cluster): k-means started from the means of the occupied cells of side ``tolerance``; at most (1 / tolerance + 1)**columns of them.

    A point is compared with the centre that started in its own cell and, where it lies within a tenth of a side of
    the border, with the one beyond.
    """
    names = [c for c in values.columns if c != "key"]
    cells = [f"c{i}" for i in range(len(names))]
    spread = values
    for c, v in zip(cells, names):
        side = F.col(v) / tolerance
        spread = spread.withColumn(c, F.explode(F.array_distinct(F.array(F.floor(side), F.floor(side + 0.1), F.floor(side - 0.1)))))
    spread = written(spread)
    held = values.select("*", *[F.floor(F.col(v) / tolerance).alias(c) for c, v in zip(cells, names)])
    gap = sum(((F.col(v) - F.col(f"m_{v}")) ** 2 for v in names), F.lit(0.0))
    for _ in range(rounds):
        centres = held.groupBy(*cells).agg(*[F.avg(v).alias(f"m_{v}") for v in names])
        held = written(spread.join(centres, cells).groupBy("key").agg(F.min_by(F.struct(*cells, *names), F.struct(gap.alias("gap"), *cells)).alias("x")).select("key", "x.*"))
    return held.select("key", F.xxhash64(*cells).alias("cluster"))


def _joined(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, node): linked keys of one cluster get one node, the least key nearby."""
    left, right = clusters.select(F.col("key").alias("a"), F.col("cluster").alias("of_a")), clusters.select(F.col("key").alias("b"), F.col("cluster").alias("of_b"))
    inside = written(links.select("a", "b").join(left, "a").join(right, "b").filter("of_a = of_b").select("a", "b"))
    nodes = clusters.select("key", F.col("key").alias("node"))
    for _ in range(2):
        low = inside.join(nodes.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("node").alias("low"))
        near = nodes.join(low, "key", "left").select("key", F.least("node", "low").alias("node"))
        jump = near.select(F.col("key").alias("node"), F.col("node").alias("further"))
        nodes = written(near.join(jump, "node", "left").select("key", F.coalesce("further", "node").alias("node")))
    return nodes


def spectral_labels(links: DataFrame, rounds: int = 4, tolerance: float = TOLERANCE, levels: int = LEVELS) -> DataFrame:
    """(key, label) of every vector in a group of two or more."""
    labels, left = None, links.count()
    for level in range(levels):
        if not left:
            break
        nodes = _joined(links, kmeans(power_iteration(links, rounds, level), tolerance * 2**level))
        if labels is None:
            labels = nodes.select("key", F.col("node").alias("label"))
        else:
            labels = written(labels.join(nodes.withColumnRenamed("key", "label"), "label", "left").select("key", F.coalesce("node", "label").alias("label")))
        ends = links.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("at_a")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("at_b")), "b")
        links = written(ends.filter("at_a <> at_b").groupBy(F.col("at_a").alias("a"), F.col("at_b").alias("b")).agg(F.sum("weight").alias("weight")))
        before, left = left, links.count()
        rounds = rounds if left < before else 2 * rounds
    if left:
        raise RuntimeError(f"{left} affinities join vectors that {levels} levels have not brought together")
    return links.select(F.col("a").alias("key"), F.col("b").alias("label")) if labels is None else labels


def groups(emb: DataFrame, least: float = 0.9, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(usable rows, (vec_id, root_id) of all members of groups of two or more)."""
    rows = usable(emb)
    ids = written(rows.select("space", "key", "vec_id"))
    labels = spectral_labels(written(affinities(rows, ids, least, near)))
    # Equal vectors without any link are a group of their own; their key serves as label.
    copies = ids.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    by_key = copies.join(labels, "key", "left").filter("label IS NOT NULL OR n > 1").withColumn("label", F.coalesce("label", "key"))
    roots = by_key.groupBy("label").agg(F.min("first").alias("root_id"))
    named = by_key.join(roots, "label").select("key", "root_id")
    return rows, ids.join(named, "key").select("vec_id", "root_id")


def linked(emb: DataFrame, least: float = 0.9, near: int = NEAR) -> DataFrame:
    """(root_id, vec_id) of every member but its group's smallest."""
    return groups(emb, least, near)[1].filter(F.col("vec_id") != F.col("root_id")).select("root_id", "vec_id")


def described(emb: DataFrame, least: float = 0.9, typical: int = 5, near: int = NEAR) -> DataFrame:
    """(root_id, size, representative_keyword, typical): each group with its most typical members' texts by internal affinity."""
    rows, members = groups(emb, least, near)
    members = written(members)

    def units(parts):
        for part in parts:
            if len(part):
                yield part.assign(unit=list(unit(part["vec"]))).drop(columns="vec")

    text = emb.select("vec_id", "text")
    own = written(rows.select("vec_id", "vec").join(members, "vec_id").groupBy("vec_id", "root_id").agg(F.first("vec").alias("vec")).mapInPandas(lambda it: (x for d in it if len(d) for _, p in d.groupby(d["vec"].str.len()) for x in units([p])), "vec_id bigint, root_id bigint, unit array<double>"))
    sums = own.groupBy("root_id").agg(Summarizer.sum(array_to_vector("unit")).alias("total")).select("root_id", vector_to_array("total").alias("total"))
    score = F.aggregate(F.zip_with("unit", "total", lambda u, t: u * t), F.lit(0.0), lambda a, x: a + x)
    ranked = own.join(sums, "root_id").select("vec_id", "root_id", score.alias("affinity")).withColumn("r", F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("affinity"), "vec_id"))).filter(F.col("r") <= typical)
    sizes = members.groupBy("root_id").agg(F.count("*").alias("size"))
    tops = ranked.join(text, "vec_id").groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("typical"))
    return sizes.join(tops, "root_id").select("root_id", "size", F.col("typical")[0]["text"].alias("representative_keyword"), F.col("typical")["text"].alias("typical"))

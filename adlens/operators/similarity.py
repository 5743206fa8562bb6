"""Similarity of short texts, and joins on it that lose no pair.

``token_links`` joins on Jaccard similarity of token sets by prefix filtering: with tokens ordered by rarity, two sets of
similarity t or more share a token among their first len - ceil(t * len) + 1. Equal token sets are one row before the join, so a set
that holds a third of all rows costs nothing; where only numbers of links are asked for, no pair of short sets is formed. ``blocked_links`` compares all pairs in blocks with any of the measures and
is meant for inputs for which a quadratic number of comparisons is acceptable.

Defined cases: null texts are left out; two texts without tokens have similarity 1, one without tokens 0; equal texts are
linked to each other.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.text import keyword_tokens, norm_keyword
from adlens.session import written


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; norms below 1e-12 count as 1e-12."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def lexical_ratio(a: str, b: str) -> float:
    """Greater of the token Jaccard similarity and the matching-blocks ratio of two normalised texts; the order matters."""
    x, y = set(a.split()), set(b.split())
    j = 1.0 if not x and not y else len(x & y) / len(x | y)
    return max(j, difflib.SequenceMatcher(None, a, b).ratio())


def token_sort_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length of the texts with their words sorted."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 1.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a`` in one long integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def token_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, tokens) of the distinct token sets of (id, text), and (id, set_id)."""
    rows = texts.filter("text IS NOT NULL").select("id", F.array_sort(F.array_distinct(keyword_tokens(F.col("text")))).alias("tokens"))
    members = written(rows.select("id", F.xxhash64("tokens").alias("set_id"), "tokens"))
    return members.groupBy("set_id").agg(F.first("tokens").alias("tokens")), members.select("id", "set_id")


def set_links(sets: DataFrame, least: float, above: int = 0) -> DataFrame:
    """(a, b, score), a < b: pairs of token sets with Jaccard similarity of at least ``least``, one of which has over ``above`` tokens."""
    tokens = sets.select("set_id", F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ordered = tokens.join(rarity, "token").withColumn("at", F.row_number().over(Window.partitionBy("set_id").orderBy("n", "token")))
    sizes = sets.select("set_id", F.size("tokens").alias("size"))
    # The small term keeps products such as 0.7 * 10 from being rounded up.
    prefix = written(ordered.join(sizes, "set_id").filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("token", "set_id", "size"))
    left = prefix.filter(F.col("size") > above).select("token", F.col("set_id").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("token", F.col("set_id").alias("b"), F.col("size").alias("size_b"))
    near = left.join(right, "token").filter(((F.col("a") < F.col("b")) | (F.col("size_b") <= above)) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-9)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = sets.select(F.col("set_id"), "tokens")
    scored = near.join(full.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), "a").join(full.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")), "b")
    return scored.withColumn("score", jaccard(F.col("ta"), F.col("tb"))).filter(F.col("score") >= least).select("a", "b", "score")


def token_links(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, links): for each text the number of other texts with Jaccard similarity of at least ``least``.

    Links are counted, not listed: with N(S) token sets of some size that hold the tokens S, those that share t or more tokens with a
    set x are the sum over the subsets S of x of (-1)^(|S| - t) * C(|S| - 1, t - 1) * N(S). That takes as many rows as sets have subsets
    of the least size that counts, whatever the number of links; pairs with a set of over ``COUNTED`` tokens are joined instead.
    """
    sets, members = token_sets(texts)
    sized = written(sets.join(members.groupBy("set_id").agg(F.count("*").alias("n")), "set_id").withColumn("size", F.size("tokens")))
    counted = _counted_links(sized.filter(F.col("size") <= COUNTED), least)
    pairs = set_links(sized.select("set_id", "tokens"), least, above=COUNTED)
    sizes = sized.select("set_id", "n")
    ends = pairs.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
    joined = ends.join(sizes.select(F.col("set_id").alias("other"), "n"), "other").select("set_id", "n")
    beyond = joined.unionByName(counted).groupBy("set_id").agg(F.sum("n").alias("beyond"))
    return members.join(sizes, "set_id").join(beyond, "set_id", "left").select("id", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))


#: Token sets of up to so many tokens have few enough subsets to be counted by them.
COUNTED = 8


def _counted_links(sized: DataFrame, least: float) -> DataFrame:
    """(set_id, n): rows of other sets with Jaccard similarity of at least ``least``, of (set_id, tokens, n, size <= COUNTED)."""
    sizes = range(COUNTED + 1)
    # Least number of common tokens by both sizes, COUNTED + 1 where none will do.
    common = [[next((c for c in range(1, min(x, y) + 1) if c / (x + y - c) >= least), COUNTED + 1) for y in sizes] for x in sizes]
    weights = [(-1) ** (k - t) * math.comb(k - 1, t - 1) if (t := common[x][y]) <= k else 0 for k in sizes for x in sizes for y in sizes]

    def held_by(mask: Column) -> Column:
        return F.struct(F.bit_count(mask).alias("k"), F.array_join(F.filter("tokens", lambda w, i: F.getbit(mask, i) == 1), " ").alias("subset"))

    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.col("size")) - 1), lambda m: F.bit_count(m) >= F.get(F.lit([min(row) for row in common]), F.col("size")))
    subsets = sized.filter("size > 0").select("set_id", "n", "size", F.explode(F.transform(masks, held_by)).alias("s")).select("set_id", "n", "size", "s.k", "s.subset")
    holders = subsets.groupBy("subset", F.col("size").alias("other")).agg(F.sum("n").alias("held"))
    weight = F.get(F.lit(weights), (F.col("k") * len(sizes) + F.col("size")) * len(sizes) + F.col("other"))
    met = subsets.join(holders, "subset").withColumn("weight", weight).filter("weight <> 0")
    return met.groupBy("set_id", "n").agg(F.sum(F.col("held") * F.col("weight")).alias("met")).select("set_id", (F.col("met") - F.col("n")).alias("n"))


def blocked_links(texts: DataFrame, measure: Callable[[str, str], float], least: float, block: int = 1000) -> DataFrame:
    """(a, b, score), a < b: all pairs of (id, text) with ``measure`` of the normalised texts of at least ``least``.

    Rows are numbered into blocks by a hash of the id; tasks compare one pair of blocks. Both ratios stay below
    2 * common characters / total length, or below the Jaccard similarity of the words; both bounds are found for all pairs of two
    blocks at once, and only pairs that may reach ``least`` are measured.
    """
    rows = written(texts.filter("text IS NOT NULL").select("id", norm_keyword(F.col("text")).alias("norm")))
    blocks = max(1, -(-rows.count() // block))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "norm")).alias("rows"))
    # Every block is sent to the pairs of blocks it belongs to.
    sent = held.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"), "block", "rows").select(F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "rows")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        by = {int(b): sorted((r["id"], r["norm"]) for r in rows) for b, rows in zip(part["block"], part["rows"])}
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        out = []
        if x in by and y in by:
            left, right = by[x], by[y]
            for p, q in zip(*np.nonzero(_may_reach([t for _, t in left], [t for _, t in right], least))):
                (i, s), (j, t) = left[p], right[q]
                if i != j and (i < j or x != y):
                    a, b, s, t = (i, j, s, t) if i < j else (j, i, t, s)
                    score = measure(s, t)
                    if score >= least:
                        out.append((a, b, score))
        return pd.DataFrame(out, columns=["a", "b", "score"])

    return sent.groupBy("x", "y").applyInPandas(compare, "a bigint, b bigint, score double")


def blocked_vector_links(vectors: DataFrame, least: float, block: int = 4000, forest: bool = False) -> DataFrame:
    """(a, b, score), a < b: all pairs of (id, vec) of one length with a cosine of at least ``least``, by products of blocks.

    Vectors with nulls, NaN or zeros only are left out. Rows are packed into blocks where they lie; every pair of blocks is a row of a
    product of the packed table with itself, which is read anew by each task, so nothing is copied to disk a second time. The number of
    products grows with the square of the rows; for tables far larger search an index instead. With ``forest`` only as many
    pairs of two blocks come out as connect what their pairs connect, without score: as many as rows at most.
    """
    packed = _packed(vectors, block)
    x, y = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "xy")
    # Of the two orders of a pair one counts, now this and now that, so that all tasks have as much to do.
    once = (F.col("block_x") == F.col("block_y")) | ((F.col("block_x") < F.col("block_y")) == ((F.col("block_x") + F.col("block_y")) % 2 == 0))
    pairs = x.join(y.hint("shuffle_replicate_nl"), once & (F.col("dim_x") == F.col("dim_y")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                (ia, ma), (ib, mb) = ((np.frombuffer(row[f"ids_{s}"].as_buffer(), np.int64), _unit_rows(row[f"vecs_{s}"].as_buffer(), row[f"kind_{s}"].as_py(), row["dim_x"].as_py())) for s in "xy")
                same, edges = row["block_x"] == row["block_y"], []
                for i, j, score in _near_rows(ma, mb, least):
                    a, b = ia[i], ib[j]
                    keep = (a < b) if same else a != b
                    a, b, score = np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[keep]
                    if forest:
                        edges.append(spanning(a, b))
                    elif len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "score"])
                if edges:
                    a, b = spanning(*map(np.concatenate, zip(*edges)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], ["a", "b", "score"])

    return pairs.mapInArrow(compare, "a bigint, b bigint, score double")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest node of every connected component of the edges (a, b) to its others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    others = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[others]], nodes[others]


def _packed(vectors: DataFrame, block: int) -> DataFrame:
    """(block, dim, kind, ids, vecs): up to ``block`` usable vectors of one length a row, as bytes of their own number type."""
    fine = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    names = ["block", "dim", "kind", "ids", "vecs"]

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, open_ = TaskContext.get().partitionId() << 32, {}

        def closed(dim: int) -> pd.DataFrame:
            nonlocal made
            ids, vecs = map(np.concatenate, zip(*open_.pop(dim)))
            made += 1
            return pd.DataFrame([(made - 1, dim, vecs.dtype.str, ids.tobytes(), vecs.tobytes())], columns=names)

        for part in parts:
            for dim, own in part.groupby(part["vec"].str.len()):
                ids, vecs = own["id"].to_numpy(np.int64), np.stack(own["vec"])
                vecs = vecs if vecs.dtype.kind == "f" else vecs.astype(float)
                while len(ids):
                    room = block - sum(len(i) for i, _ in open_.get(dim, []))
                    open_.setdefault(dim, []).append((ids[:room], vecs[:room]))
                    full, ids, vecs = len(ids) >= room, ids[room:], vecs[room:]
                    if full:
                        yield closed(dim)
        for dim in list(open_):
            yield closed(dim)

    return written(vectors.filter(fine).select(F.col("id").cast("bigint").alias("id"), "vec").mapInPandas(pack, "block bigint, dim int, kind string, ids binary, vecs binary"), rows_a_file=8)


def _unit_rows(data: pa.Buffer, kind: str, dim: int) -> np.ndarray:
    m = np.frombuffer(data, kind).reshape(-1, dim).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _near_rows(left: np.ndarray, right: np.ndarray, least: float, tile: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of unit rows with a product of at least ``least``, a tile at a time: single precision, less all that its rounding
    may take away, tells the rows and columns that are multiplied in double precision."""
    a, b = left.astype(np.float32), right.astype(np.float32)
    bound = np.float32(least - 1e-6 - 2.5e-7 * left.shape[1])
    for p in range(0, len(a), tile):
        for q in range(0, len(b), tile):
            rough = a[p : p + tile] @ b[q : q + tile].T
            rows = np.flatnonzero(rough.max(axis=1) >= bound)
            if len(rows):
                columns = np.flatnonzero(rough[rows].max(axis=0) >= bound)
                score = left[p + rows] @ right[q + columns].T
                i, j = np.nonzero(score >= least)
                yield p + rows[i], q + columns[j], score[i, j]


def _counts(rows: list[list[str]]) -> tuple[np.ndarray, dict[str, int]]:
    known: dict[str, int] = {}
    at = [(i, known.setdefault(x, len(known))) for i, row in enumerate(rows) for x in row]
    out = np.zeros((len(rows), len(known)), np.float32)
    if at:
        np.add.at(out, tuple(np.array(at).T), 1)
    return out, known


def _may_reach(left: list[str], right: list[str], least: float) -> np.ndarray:
    """Whether a pair's common characters or common words allow a similarity of ``least``: an upper bound for every pair."""
    n = len(left)
    chars, _ = _counts([list(t) for t in left + right])
    common = np.zeros((n, len(right)), np.float32)
    for column in chars.T:
        held, other = np.flatnonzero(column[:n]), np.flatnonzero(column[n:])
        common[np.ix_(held, other)] += np.minimum(column[held][:, None], column[n + other])
    total = np.add.outer(np.array([len(t) for t in left]), np.array([len(t) for t in right]))
    words, _ = _counts([sorted(set(t.split())) for t in left + right])
    both = words[:n] @ words[n:].T
    either = np.add.outer(words[:n].sum(axis=1), words[n:].sum(axis=1)) - both
    return (2 * common >= least * total - 1e-4) | (both >= least * either - 1e-4)

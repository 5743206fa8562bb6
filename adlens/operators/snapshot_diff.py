"""Changes between consecutive full deliveries, found by comparing Merkle trees.

Keys are placed in leaf buckets by the high bits of a hash. A bucket's digest is the sum of its rows' digests, which does
not depend on order; an inner node's digest is the sum of its children's. Trees of consecutive deliveries are compared
from the root downwards, one level at a time, and a node's children are looked at only where its digests differ. Rows are
compared only in the leaves that are left.

Defined cases: rows with null text, null url or null delivery are ignored. Of several rows of one page in a delivery the
one with the greatest (fetched_at, tie-break column) counts, null fetched_at being the smallest. A delivery without any
rows that count is no delivery: the one before it is the numerically preceding one (``delivery - 1``) and if that is
absent, nothing is reported for the later one. Empty texts are texts. Further columns are dropped first, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.session import written


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case; no fragment, no ``utm_`` parameters, no slash at the end of the path."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^([^/?]*//[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^(?:[^/?]*//[^/?]*)?([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.concat(F.lower(head), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def squeezed(text: Column) -> Column:
    """Runs of space, tab and newline as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\n]+", " "))


def row_digests(snapshots: DataFrame, tie: str = "snap_id") -> DataFrame:
    """One row per (delivery, page): page, place (key hash), digest of the squeezed text.

    All that a comparison needs of a delivery: kept as a table, with those of a new delivery appended, no text is read twice.
    """
    rows = snapshots.filter(F.col("text").isNotNull() & F.col("url").isNotNull() & F.col("delivery").isNotNull()).select(
        F.col("delivery").cast("int").alias("delivery"), normal_url(F.col("url")).alias("page"), F.col("fetched_at"), F.col(tie).alias("tie"), F.unhex(F.sha2(squeezed(F.col("text")), 256)).alias("digest")
    )
    return (
        rows.groupBy("delivery", "page").agg(F.max_by("digest", F.struct("fetched_at", "tie")).alias("digest")).withColumn("place", F.xxhash64("page"))
    )


def bits_for(pages: int) -> int:
    """Bits that give about one page a leaf, so that a leaf that differs holds little else than what differs."""
    return min(48, max(4, (max(1, pages) - 1).bit_length()))


def merkle_levels(latest: DataFrame, leaf_bits: int, level_bits: int) -> list[DataFrame]:
    """Trees of all deliveries, root level first; each level: delivery, node, digest sums a and b."""
    hashed = latest.select("delivery", F.shiftrightunsigned("place", 64 - leaf_bits).alias("node"), F.xxhash64("page", "digest").alias("a"), F.xxhash64("digest", "page", F.lit(7)).alias("b"))
    # Sums of 64-bit digests wrap around: kept as decimals of their halves, so that ANSI mode raises no overflow.
    parts = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("a", "b")]
    level = written(hashed.groupBy("delivery", "node").agg(*parts, F.count("*").alias("n")))
    levels, bits = [level], leaf_bits
    while bits > 0:
        step = min(level_bits, bits)
        level = level.groupBy("delivery", F.shiftrightunsigned("node", step).alias("node")).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")], F.sum("n").alias("n"))
        levels.append(level)
        bits -= step
    return levels[::-1]


def differing_leaves(levels: list[DataFrame], leaf_bits: int, level_bits: int) -> DataFrame:
    """(delivery, node) of the leaves that differ from the delivery before, found from the root down."""
    steps, bits = [], leaf_bits
    while bits > 0:
        steps.append(min(level_bits, bits))
        bits -= steps[-1]
    steps = steps[::-1]
    open_nodes = None
    for depth, level in enumerate(levels):
        if open_nodes is not None:
            here = F.shiftrightunsigned("node", steps[depth - 1])
            level = level.withColumn("parent", here)
            # A node is needed for both comparisons it takes part in.
            both = open_nodes.select("delivery", F.col("node").alias("parent")).unionByName(open_nodes.select((F.col("delivery") - 1).alias("delivery"), F.col("node").alias("parent"))).distinct()
            level = level.join(both, ["delivery", "parent"], "left_semi").drop("parent")
        new = level.select("delivery", "node", "a", "b", "n", F.lit(1).alias("side"))
        old = level.select((F.col("delivery") + 1).alias("delivery"), "node", "a", "b", "n", F.lit(0).alias("side"))
        sides = new.unionByName(old).groupBy("delivery", "node").agg(
            *[F.max(F.when(F.col("side") == s, F.struct("a", "b", "n"))).alias(f"s{s}") for s in (0, 1)]
        )
        differ = sides.filter(~F.col("s0").eqNullSafe(F.col("s1"))).select("delivery", "node")
        if open_nodes is not None:
            differ = differ.withColumn("parent", F.shiftrightunsigned("node", steps[depth - 1])).join(open_nodes.select("delivery", F.col("node").alias("parent")), ["delivery", "parent"], "left_semi").drop("parent")
        open_nodes = written(differ)  # few rows, used on both sides of the next level
    return open_nodes


def open_rows(digests: DataFrame, leaf_bits: int | None = None, level_bits: int = 8) -> DataFrame:
    """(delivery, page, digest, side): the rows in leaves that differ, side 1 of the delivery and side 0 of the one before it."""
    if leaf_bits is None:
        most = digests.groupBy("delivery").count().agg(F.max("count")).first()[0]
        leaf_bits = bits_for(most or 0)
    levels = merkle_levels(digests, leaf_bits, level_bits)
    there = levels[0].select("delivery").distinct()
    compared = there.join(there.select((F.col("delivery") + 1).alias("delivery")), "delivery", "left_semi")
    leaves = differing_leaves(levels, leaf_bits, level_bits).join(F.broadcast(compared), "delivery", "left_semi")
    rows = digests.withColumn("node", F.shiftrightunsigned("place", 64 - leaf_bits))
    sides = rows.withColumn("side", F.lit(1)).unionByName(rows.withColumn("delivery", F.col("delivery") + 1).withColumn("side", F.lit(0)))
    return sides.join(leaves, ["delivery", "node"], "left_semi").select("delivery", "page", "digest", "side")


def changes(digests: DataFrame, leaf_bits: int | None = None, level_bits: int = 8) -> DataFrame:
    """(delivery, url, change_kind) from ``row_digests`` of the deliveries.

    2**leaf_bits leaf buckets, by default about one page a leaf in the largest delivery.
    """
    # One shuffle by (delivery, page) brings both sides together; at most two digests meet in a group.
    near = open_rows(digests, leaf_bits, level_bits)
    paired = near.groupBy("delivery", "page").agg(*[F.max(F.when(F.col("side") == s, F.col("digest"))).alias(f"d{s}") for s in (0, 1)])
    kind = F.when(F.col("d0").isNull(), "added").when(F.col("d1").isNull(), "removed").when(F.col("d0") != F.col("d1"), "changed")
    return paired.select("delivery", F.col("page").alias("url"), kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())


def snapshot_changes(snapshots: DataFrame, tie: str = "snap_id", leaf_bits: int | None = None, level_bits: int = 8) -> DataFrame:
    """(delivery, url, change_kind) for every delivery against the one before it."""
    return changes(written(row_digests(snapshots, tie)), leaf_bits, level_bits)

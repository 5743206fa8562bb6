"""Neighbourhood index over embedding rows, shared by the nearest-vector search and the clustering.

Usable rows of one (provider, model, req_dim) form a space. Equal vectors share a 64-bit key, and only one of them goes on.
Cells are the leaves of a k-means tree fitted on a bounded sample of at most ``SAMPLE`` vectors; every vector is indexed,
in its ``near`` nearest cells. Where these cells would hold more than some ``DEEP`` times ``HOME`` rows, as in tables far larger than the
sample, each is divided by a tree of its own, fitted in parallel on every eighth of its rows: the number of cells follows the
table and their size does not. The nearest-vector search estimates inner products inside a cell from randomly rotated one-bit codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import written

#: Most vectors that the cells are fitted on, and rows that a cell is home to while the sample allows.
SAMPLE, HOME = 32_000, 64
#: Times ``HOME`` that a cell may be expected to hold before it is divided; cells of the first level and parts of each that a row of a
#: divided index is placed in; rows that one task divides at a time.
DEEP, FIRST, SECOND, AT_ONCE = 8, 4, 3, 50_000
#: Rank of the error bound: a true inner product is outside with probability below exp(-EPS**2 / 2).
EPS = 3.0


def usable(emb: DataFrame) -> DataFrame:
    """(vec_id, space, key, vec) of rows with a vector of length dim, without NaN, infinity or nulls, and not all zero."""
    fine = F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = emb.select("vec_id", "provider", "model", "req_dim", "dim", "vec").filter(fine)
    space = F.xxhash64("provider", "model", F.coalesce("req_dim", F.lit(-1)), F.size("vec"))
    return rows.select("vec_id", space.alias("space"), F.xxhash64("provider", "model", F.coalesce("req_dim", F.lit(-1)), "vec").alias("key"), "vec")


def unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans_tree(x: np.ndarray, leaf: float, rng: np.random.Generator, branch: int = 8, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of the leaves of a k-means tree that stops at ``leaf`` rows."""
    out, sizes, todo = [], [], [x]
    while todo:
        rows = todo.pop()
        k = min(branch, math.ceil(len(rows) / max(leaf, 1)))
        if k < 2:
            out.append(rows.mean(axis=0))
            sizes.append(len(rows))
            continue
        centres = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            near = (rows @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            centres = np.stack([rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
        parts = [p for i in range(k) if len(p := rows[near == i])]
        if len(parts) == 1:  # inseparable rows
            out.append(rows.mean(axis=0))
            sizes.append(len(rows))
        else:
            todo += parts
    return np.stack(out).astype(np.float32), np.array(sizes)


def fit_cells(rows: DataFrame, keys: DataFrame, home: int = HOME, seed: int = 7, sample: int = SAMPLE) -> tuple[dict[int, np.ndarray], float]:
    """Cell centres of every space, and how many rows the largest cell is expected to be home to; ``keys`` has space and key of ``rows``."""
    counts = {r["space"]: r["n"] for r in keys.groupBy("space").agg(F.approx_count_distinct("key").alias("n")).collect()}
    every = max(1, math.ceil(sum(counts.values()) / sample))
    drawn = rows.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).dropDuplicates(["key"]).select("space", "key", "vec").toPandas()
    rng, cells, most = np.random.default_rng(seed), {}, 0.0
    for space in sorted(counts):
        own = drawn[drawn["space"] == space].sort_values("key")
        if len(own):
            cells[space], sizes = kmeans_tree(unit(own["vec"]).astype(np.float32), max(4, home / every), rng)
            most = max(most, float(sizes.max()) * every)
        else:  # a space that the sample missed is one cell
            most = max(most, counts[space])
    return cells, most


def indexed(rows: DataFrame, keys: DataFrame, near: int, home: int = HOME, sample: int = SAMPLE) -> DataFrame:
    """(space, cell, key, code): each distinct vector of ``rows`` in the cells where its neighbours are looked for."""
    cells, most = fit_cells(rows, keys, home, sample=sample)
    if most <= DEEP * home:
        return placed(rows, cells, near)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key").sort_values("key")
        centres, _ = kmeans_tree(decoded(part["code"].tolist()), home / 8, np.random.default_rng(int(part["cell"].iloc[0])))
        return pd.DataFrame({"space": part["space"].iloc[0], "cell": part["cell"].iloc[0], "centre": [c.tobytes() for c in centres]})

    some = rows.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(8)) == 0)
    parts = written(placed(some, cells, 1).groupBy("space", "cell").applyInPandas(fit, "space bigint, cell bigint, centre binary"))
    # A cell is divided by several tasks, each with some of its rows and all of its centres.
    tasks = max(1, math.ceil(most * FIRST / AT_ONCE))
    left = placed(rows, cells, FIRST).withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    right = parts.withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))))

    def divide(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own[["space", "cell", "key", "code"]]
        names = sorted(centres["centre"]) or [np.zeros(len(own["code"].iloc[0]) // 2, np.float32).tobytes()]
        m = np.frombuffer(b"".join(names), np.float32).reshape(len(names), -1)
        score = decoded(own["code"].tolist()) @ m.T - 0.5 * (m**2).sum(axis=1)
        r = min(SECOND, len(m))
        best = np.argpartition(-score, r - 1, axis=1)[:, :r]
        keep = np.repeat(np.arange(len(own)), r)
        return pd.DataFrame({"space": own["space"].to_numpy()[keep], "cell": (own["cell"].to_numpy()[keep] << 24) + best.ravel(), "key": own["key"].to_numpy()[keep], "code": own["code"].to_numpy(object)[keep]})

    by = ["space", "cell", "task"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(divide, "space bigint, cell bigint, key bigint, code binary")


def placed(rows: DataFrame, cells: dict[int, np.ndarray], near: int) -> DataFrame:
    """(space, cell, key, code): each vector in its ``near`` nearest cells, as 16-bit integers; equal ones of a batch once."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.drop_duplicates("key")  # copies in other batches meet in their cells
            for space, own in part.groupby("space"):
                x = unit(own["vec"])
                # A space that the sample missed is one cell.
                centres = shared.value.get(space, np.zeros((1, x.shape[1]), np.float32))
                score = x.astype(np.float32) @ centres.T - 0.5 * (centres**2).sum(axis=1)
                r = min(near, len(centres))
                best = np.argpartition(-score, r - 1, axis=1)[:, :r]
                codes = [c.tobytes() for c in np.rint(x * (32767 / np.abs(x).max(axis=1, keepdims=True))).astype("<i2")]
                yield pd.DataFrame({"space": space, "cell": best.ravel().astype(np.int64), "key": np.repeat(own["key"].to_numpy(), r), "code": np.repeat(np.array(codes, object), r)})

    return rows.select("space", "key", "vec").mapInPandas(place, "space bigint, cell bigint, key bigint, code binary")


@lru_cache(4)
def rotation(d: int) -> np.ndarray:
    """Random orthogonal map of d dimensions into the next multiple of 64."""
    size = -(-d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:d].astype(np.float32)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


class OneBitCodes:
    """Packed sign bits of the rotated residuals of unit rows ``x``, with the scalars of the estimator."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre = x.mean(axis=0)
        rest = x - self.centre
        self.length = np.linalg.norm(rest, axis=1)
        z = (rest / np.maximum(self.length, 1e-12)[:, None]) @ rotation(x.shape[1])
        self.d = d = z.shape[1]
        self.bits = _packed(z > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int32)
        self.align = np.maximum(np.abs(z).sum(axis=1) / math.sqrt(d), 1e-6)
        self.error = EPS * np.sqrt(np.maximum(1 - self.align**2, 0)) / self.align / math.sqrt(d - 1)
        self.low = z.min(axis=1)
        self.step = np.maximum((z.max(axis=1) - self.low) / 15, 1e-9)
        level = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_packed((level >> j) & 1) for j in range(4)]
        self.level_sum = level.sum(axis=1, dtype=np.int32)
        self.own = rest @ self.centre
        self.base = float(self.centre @ self.centre)

    def bounds(self, a: int, b: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of rows a..b with the rows from ``first`` on."""
        bits = self.bits[first:]
        dots = np.zeros((b - a, len(bits)), np.int32)
        wide = np.uint8 if self.d < 256 else np.uint16  # so many bits one sum can hold
        for j, plane in enumerate(self.planes):
            count = np.bitwise_count(plane[a:b, 0, None] & bits[None, :, 0]).astype(wide, copy=False)
            for w in range(1, plane.shape[1]):
                count += np.bitwise_count(plane[a:b, w, None] & bits[None, :, w])
            dots += np.multiply(count, 1 << j, dtype=np.int32)
        root = math.sqrt(self.d)
        low, step, align = self.low[a:b, None], self.step[a:b, None], self.align[first:]
        est = (2 * step * dots + 2 * low * self.ones[first:] - step * self.level_sum[a:b, None]) / root - root * low
        scale = self.length[a:b, None] * self.length[first:]
        # Rounding a query to 4 bits moves it by half a step in every direction at most: on average step / sqrt(12).
        slack = scale * (self.error[first:] + EPS * step / math.sqrt(12) / align)
        middle = self.base + self.own[a:b, None] + self.own[first:] + scale * (est / align)
        return middle - slack, middle + slack

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), 100_000):
            out[s : s + 100_000] = np.einsum("ij,ij->i", self.x[i[s : s + 100_000]], self.x[j[s : s + 100_000]])
        return out

    def nearest(self, least: float, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (i, j, exact product) that hold the ``top`` best of every row with products from ``least``."""
        n = len(self.x)
        block = max(8, min(512, 2_000_000 // n))
        for a in range(0, n, block):
            b = min(n, a + block)
            lower, upper = self.bounds(a, b)
            mine = np.arange(a, b)
            lower[mine - a, mine] = upper[mine - a, mine] = -2
            keep = upper >= least
            if n > top + 1:
                keep &= upper >= -np.partition(-lower, top - 1, axis=1)[:, top - 1 : top]
            i, j = np.nonzero(keep)
            i += a
            exact = self._exact(i, j)
            fine = exact >= least
            yield i[fine], j[fine], exact[fine]


def decoded(codes) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), "<i2").reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)

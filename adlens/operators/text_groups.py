"""Links that connect the groups of similar short texts, without a comparison of all pairs.

A group is a connected component, so that of the links between its members only those that connect it are needed. All texts are compared
with some texts, the hub; where texts are alike, most then lie in one component. What lies elsewhere is compared with everything else:
every pair of texts is compared, or has both texts in one component already.

Defined cases: null texts are left out; equal texts are linked; results are those of a comparison of all pairs.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.text import norm_keyword
from adlens.operators.graph import components
from adlens.operators.similarity import _may_reach, common_length, spanning, token_sort_ratio
from adlens.session import written

#: Texts of the hub, numbers (a character's n-th place in a text) that the bound on common characters tells apart.
HUB, COLUMNS = 8000, 127


def group_links(texts: DataFrame, measure: Callable[[str, str], float], least: float, hub: int = HUB, block: int = 4000) -> DataFrame:
    """(a, b), a < b: links of (id, text) with the connected components of all pairs with ``measure`` of at least ``least``, the text of the
    smaller id coming first."""
    ids = written(texts.filter("text IS NOT NULL").select("id", norm_keyword(F.col("text")).alias("norm")))
    rows = written(ids.groupBy("norm").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("mixed", F.xxhash64("norm")))
    equal = ids.join(rows, "norm").filter((F.col("id") > F.col("lo")) & F.lit(least <= 1)).select(F.col("lo").alias("a"), F.col("id").alias("b"))
    first = rows.orderBy("mixed", "lo").limit(hub).toPandas()
    if not len(first):
        return equal
    columns = _columns(first["norm"])
    shared = texts.sparkSession.sparkContext.broadcast((first, columns))

    def to_hub(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names = shared.value
        right = _Side(held["lo"].to_numpy(), held["hi"].to_numpy(), list(held["norm"]), names)
        for part in parts:
            left = _Side(part["lo"].to_numpy(), part["hi"].to_numpy(), list(part["norm"]), names)
            i, j = linked(left, right, measure, least)
            yield pd.DataFrame(dict(zip("ab", _edges(left.lo[i], right.lo[j]))))

    links = written(rows.select("lo", "hi", "norm").mapInPandas(to_hub, "a bigint, b bigint"))
    found = links.select("a", "b").unionByName(equal)
    after = first.iloc[-1]
    others = rows.filter((F.col("mixed") > int(after["mixed"])) | ((F.col("mixed") == int(after["mixed"])) & (F.col("lo") > int(after["lo"]))))
    if others.isEmpty():
        return found
    parts = components(links)
    largest = parts.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()
    root = largest["root"] if largest else None
    rest = others.join(parts.withColumnRenamed("node", "lo"), "lo", "left").withColumn("rest", ~F.coalesce(F.col("root") == F.lit(root).cast("bigint"), F.lit(False)))
    packed = _packed_texts(rest.select("lo", "hi", "norm", "rest"), block)
    x, y = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "xy")
    once = (F.col("block_x") == F.col("block_y")) | ((F.col("block_x") < F.col("block_y")) == ((F.col("block_x") + F.col("block_y")) % 2 == 0))
    pairs = x.filter("rest_x").join(y.hint("shuffle_replicate_nl"), ~F.col("rest_y") | once)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names = shared.value
        sides: dict[int, _Side] = {}
        for batch in batches:
            for row in batch.to_pylist():
                left, right = (sides.get(row[f"block_{s}"]) or _Side(np.frombuffer(row[f"lo_{s}"], np.int64), np.frombuffer(row[f"hi_{s}"], np.int64), row[f"norm_{s}"], names) for s in "xy")
                if row["block_x"] not in sides:
                    sides = {row["block_x"]: left}
                if row["rest_y"]:
                    i, j = linked(left, right, measure, least)
                    a, b = _edges(left.lo[i], right.lo[j])
                else:
                    # One link to the large component is enough for a text, and for this task.
                    open_ = np.flatnonzero(~left.joined)
                    i, _ = linked(left.of(open_), right, measure, least)
                    new = open_[np.unique(i)]
                    left.joined[new] = True
                    a, b = _edges(left.lo[new], np.full(len(new), root))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return found.unionByName(pairs.mapInArrow(compare, "a bigint, b bigint"))


def linked(left: _Side, right: _Side, measure: Callable[[str, str], float], least: float, tile: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all pairs with ``measure`` of at least ``least``, the text of the smaller id coming first (of equal texts any of their ids)."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for p in range(0, len(left.lo), tile):
        for q in range(0, len(right.lo), tile):
            a, b = left.of(np.arange(p, min(p + tile, len(left.lo)))), right.of(np.arange(q, min(q + tile, len(right.lo))))
            if measure is token_sort_ratio:
                # 2 * common - least * (both sizes) as one product; what single precision may lose is allowed for.
                one_a, one_b = np.ones((len(a.lo), 1), np.float32), np.ones((len(b.lo), 1), np.float32)
                size_a, size_b = ((-least * x.size).astype(np.float32)[:, None] for x in (a, b))
                near = np.hstack([2 * a.code, one_a, size_a]) @ np.hstack([b.code, size_b, one_b]).T
                i, j = np.divmod(np.flatnonzero(near >= -1e-3 - 1e-5 * (a.size.max() + b.size.max())), len(b.lo))
                common, total = _common_lengths(a, b, i, j), a.size[i] + b.size[j]
                keep = np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1)) >= least
            else:
                i, j = np.nonzero(_may_reach(a.norm, b.norm, least))
                keep = np.array([(a.lo[k] < b.hi[m] and measure(a.norm[k], b.norm[m]) >= least) or (b.lo[m] < a.hi[k] and measure(b.norm[m], a.norm[k]) >= least) for k, m in zip(i, j)], bool)
            out.append((p + i[keep], q + j[keep]))
    return tuple(map(np.concatenate, zip(*out)))


class _Side:
    """Texts with their smallest and greatest ids, their words sorted, and the code of their characters."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, norm: list[str], names: dict[tuple[int, int], int]):
        self.lo, self.hi, self.norm, self.joined = lo, hi, norm, np.zeros(len(lo), bool)
        self.sorted = [" ".join(sorted(t.split())) for t in norm]
        self.size = np.array([len(t) for t in self.sorted], np.int64)
        self.code = np.zeros((len(lo), len(names) + 1), np.float32)
        row, char, nth = _places(self.sorted)
        at = np.array([names.get(x, len(names)) for x in zip(char.tolist(), nth.tolist())], np.int64)
        np.add.at(self.code, (row, at), 1)
        # Of characters without a column two texts share as many as the one with fewer has, at most: no more than the root of the product.
        self.code[:, -1] = np.sqrt(self.code[:, -1]) * np.float32(1.00001)

    def of(self, at: np.ndarray) -> _Side:
        own = object.__new__(_Side)
        own.lo, own.hi, own.size, own.code, own.joined = self.lo[at], self.hi[at], self.size[at], self.code[at], self.joined[at]
        own.norm, own.sorted = [self.norm[k] for k in at], [self.sorted[k] for k in at]
        return own


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, character, n): the n-th of each character in each text."""
    char = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = np.lexsort((char, row))
    row, char = row[order], char[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (char[1:] != char[:-1])]) if len(row) else np.zeros(0, int)
    nth = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row, char, nth


def _columns(norms) -> dict[tuple[int, int], int]:
    _, char, nth = _places(list(norms))
    return {x: k for k, (x, _) in enumerate(Counter(zip(char.tolist(), nth.tolist())).most_common(COLUMNS))}


def _common_lengths(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 13) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs (i, j), as similarity.common_length but for many pairs at once, in words of
    64 bits."""
    out = np.zeros(len(i), np.int64)
    long = a.size[i] > 64
    out[long] = [common_length(a.sorted[k], b.sorted[m]) for k, m in zip(i[long], j[long])]
    short = np.flatnonzero(~long)
    short = short[np.argsort(b.size[j[short]], kind="stable")]  # each chunk takes as many steps as its longest text
    if not len(short):
        return out
    known: dict[str, int] = {c: k for k, c in enumerate(sorted(set("".join(a.sorted))))}
    masks = np.zeros((len(a.sorted), len(known) + 1), np.uint64)
    for k in np.unique(i[short]):
        for p, c in enumerate(a.sorted[k]):
            masks[k, known[c]] |= np.uint64(1 << p)
    used, at = np.unique(j[short], return_inverse=True)
    width = int(b.size[used].max())
    codes = np.full((width, len(used)), len(known), np.int64)
    for n, m in enumerate(used):
        codes[: b.size[m], n] = [known.get(c, len(known)) for c in b.sorted[m]]
    full = np.array([(1 << int(n)) - 1 if n <= 64 else 0 for n in a.size], np.uint64)
    flat = masks.ravel()
    for p in range(0, len(short), chunk):
        own = short[p : p + chunk]
        base, col = i[own] * (len(known) + 1), at[p : p + chunk]
        free = full[i[own]].copy()
        for t in range(int(b.size[j[own]].max())):
            met = flat.take(base + codes[t].take(col))
            met &= free
            free = (free + met) | (free - met)
        out[own] = a.size[i[own]] - np.bitwise_count(free & full[i[own]])
    return out


def _edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    return spanning(np.minimum(a, b)[keep], np.maximum(a, b)[keep])


def _packed_texts(rows: DataFrame, block: int) -> DataFrame:
    """(block, rest, lo, hi, norm): up to ``block`` texts a row."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, open_ = TaskContext.get().partitionId() << 32, {}
        for part in itertools.chain(parts, [None]):
            for rest in (False, True):
                held = open_.get(rest)
                if part is not None:
                    own = part[part["rest"] == rest]
                    held = own if held is None else pd.concat([held, own])
                while held is not None and len(held) and (part is None or len(held) >= block):
                    own, held = held[:block], held[block:]
                    yield pd.DataFrame([(made, rest, own["lo"].to_numpy(np.int64).tobytes(), own["hi"].to_numpy(np.int64).tobytes(), list(own["norm"]))], columns=["block", "rest", "lo", "hi", "norm"])
                    made += 1
                open_[rest] = held

    return written(rows.mapInPandas(pack, "block bigint, rest boolean, lo binary, hi binary, norm array<string>"), rows_a_file=4)

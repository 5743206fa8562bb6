"""Filling fixed-capacity containers along a space-filling curve.

Every text gets its number of tokens and a hashed vector projected to ``DIMS`` numbers: each word adds a random direction
drawn from its hash. The numbers are standardised over the whole table, turned into grid coordinates, and these into a Hilbert
key. Texts are range-sorted by the key and packed as they come: a container starts with the next text of the curve and is
filled with the largest text that still fits out of the next ``WINDOW`` texts, so containers hold neighbours.

A text beyond the capacity is split into full containers and a rest, which is packed like any other text; no other text is split.

Defined cases: null texts are no items; empty texts are items of 0 tokens; equal texts have equal keys and are split over ranges by
their ids, so no key is too frequent; an empty table gives no rows; null capacities and those below 1 raise ValueError; any number of
kinds, repeated ones counting once. A range has at most some ``RANGE_ROWS`` texts, by the number of texts and
not by the number of partitions, and leaves at most a few containers at its end that could have been filled further.
The tokenizer's file is sent to the workers from the driver.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the rank file; it splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMS, BITS, WINDOW = 4, 10, 512
#: Texts a range, and kinds of containers that one pass over the ranges fills.
RANGE_ROWS, KINDS = 20_000, 1000


@lru_cache(2)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 14, DIMS))


def vectors(texts: list[str]) -> np.ndarray:
    """Projected word-hash vectors, scaled to unit variance per word."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    lengths = np.asarray(pc.list_value_length(words).fill_null(0))
    flat = words.flatten().dictionary_encode()
    unique = flat.dictionary.to_numpy(zero_copy_only=False).astype(object)
    ids = (pd.util.hash_array(unique, categorize=False) >> np.uint64(50)).astype(np.int64) if len(unique) else np.zeros(0, np.int64)
    at, row = ids[np.asarray(flat.indices)], np.repeat(np.arange(len(texts)), lengths)
    total = np.stack([np.bincount(row, directions()[at, d], len(texts)) for d in range(DIMS)], axis=1)
    return total / np.sqrt(np.maximum(lengths, 1))[:, None]


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows of ``grid``), by Skilling's transform."""
    x = [grid[:, i].astype(np.int64).copy() for i in range(grid.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_bit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def measured(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, v0, v1, ...) of every text."""

    name = os.path.basename(path)
    documents.sparkSession.sparkContext.addFile(path)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(SparkFiles.get(name), pattern).encode_ordinary
        for part in parts:
            texts = part["text"].tolist()
            v = vectors(texts)
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(encode(t)) for t in texts], **{f"v{d}": v[:, d] for d in range(DIMS)}})

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    return rows.mapInPandas(measure, "doc_id bigint, n_tokens int, " + ", ".join(f"v{d} double" for d in range(DIMS)))


def curve_order(sizes: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, curve_key) with the keys of the standardised vectors."""
    stats = sizes.agg(*[f(f"v{d}").alias(f"{n}{d}") for d in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{d}"] or 0.0 for d in range(DIMS)])
    spread = np.array([stats[f"s{d}"] or 1.0 for d in range(DIMS)])

    def key(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cdf = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))), otypes=[float])
        for part in parts:
            z = (part[[f"v{d}" for d in range(DIMS)]].to_numpy() - mean) / spread
            grid = np.minimum((cdf(z) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1) if len(part) else z
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": part["n_tokens"], "curve_key": hilbert_key(grid)})

    return sizes.mapInPandas(key, "doc_id bigint, n_tokens int, curve_key bigint")


def pack_along(items: Iterator[tuple[int, int]], capacity: int, window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(container, doc_id, first token, tokens) of (doc_id, tokens) items in curve order."""
    waiting: list[tuple[int, int]] = []  # (turn, doc) in the order of the curve
    by_size: list[tuple[int, int]] = []  # (size, turn)
    held: dict[int, tuple[int, int, int]] = {}
    turn = container = 0
    more = True
    items = iter(items)
    while True:
        while more and len(held) < window:
            item = next(items, None)
            if item is None:
                more = False
                break
            doc, size = item
            start = 0
            while size - start > capacity:
                yield container, doc, start, capacity
                container += 1
                start += capacity
            held[turn] = (doc, start, size - start)
            insort(by_size, (size - start, turn))
            waiting.append((turn, doc))
            turn += 1
        if not held:
            return
        at = 0
        while waiting[at][0] not in held:
            at += 1
        first = waiting[at][0]
        del waiting[: at + 1]
        room, take = capacity, first
        while take is not None:
            doc, start, size = held.pop(take)
            by_size.pop(bisect_right(by_size, (size, take)) - 1)
            yield container, doc, start, size
            room -= size
            fit = bisect_right(by_size, (room, turn))
            take = by_size[fit - 1][1] if fit else None
        container += 1


def packed(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN, window: int = WINDOW) -> DataFrame:
    """(container_kind, container_id, doc_id, start_token, n_tokens): every text in containers of every kind."""
    kinds = containers.select("container_kind", "capacity_tokens").distinct()
    if kinds.filter("capacity_tokens IS NULL OR capacity_tokens < 1").limit(1).count():
        raise ValueError("capacities must be at least 1")
    ordered = written(curve_order(written(measured(documents, path, pattern))))
    parts = max(1, -(-ordered.count() // RANGE_ROWS))
    ranged = ordered.repartitionByRange(parts, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")

    def filled(block: list[tuple[str, int]]) -> DataFrame:
        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base = TaskContext.get().partitionId() << 40
            items = [(d, n) for batch in batches for d, n in zip(batch["doc_id"].tolist(), batch["n_tokens"].tolist())]
            for kind, capacity in block:
                rows = []
                for container, doc, start, size in pack_along(items, capacity, window):
                    rows.append((kind, base + container, doc, start, size))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["container_kind", "container_id", "doc_id", "start_token", "n_tokens"])
                        rows = []
                yield pd.DataFrame(rows, columns=["container_kind", "container_id", "doc_id", "start_token", "n_tokens"])

        return ranged.mapInPandas(fill, "container_kind string, container_id bigint, doc_id bigint, start_token int, n_tokens int")

    out, listed = None, kinds.orderBy("container_kind", "capacity_tokens").toLocalIterator()
    while block := [(r["container_kind"], r["capacity_tokens"]) for r in islice(listed, KINDS)]:
        out = filled(block) if out is None else out.unionByName(filled(block))
    return filled([]) if out is None else out


def fill_rates(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, filled): the filled part of all containers' capacity."""
    per = packing.groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.join(containers.select("container_kind", "capacity_tokens"), "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))

"""Evaluation items leaking into documents: Wu-Manber multi-pattern search over normalised words.

Texts become their words (runs of letters and digits, lower case) with one space before, between and after. The patterns
are all windows of ``words`` consecutive words of the items. With m the length of the shortest pattern, blocks of B
characters of each pattern's first m characters fill a shift table; a block that stands in no pattern lets the search jump
m - B + 1 characters. Where the shift is 0, the bucket of the block's hash holds the candidate patterns, and direct
comparison confirms them.

Defined cases: null texts give no row; items of fewer than ``words`` words can't be found; repeated documents and items
count each under its own id; a document that repeats an item more than once gives one row; empty tables give no rows.
Patterns are searched in groups of whole items with at most ``group_patterns`` windows each (an item with more is its own
group), so that what the driver and a task hold is bounded however many items there are. The documents are read once: a task
takes ``TEXTS_AT_ONCE`` characters of them and searches these for one group after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
B = 8
#: Characters of documents that a task holds while it goes through the groups.
TEXTS_AT_ONCE = 64_000_000


def normal_words(text: Column) -> Column:
    """`` w1 w2 ... wn `` in lower case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def windows(items: list[tuple[int, str]], words: int) -> dict[str, set[int]]:
    """Pattern -> ids of the items that hold it; ``items`` come as ``normal_words`` has them."""
    out: dict[str, set[int]] = {}
    for item_id, text in items:
        own = text.split()
        for i in range(len(own) - words + 1):
            out.setdefault(f" {' '.join(own[i : i + words])} ", set()).add(item_id)
    return out


class WuManber:
    """Shift table by block, suffix buckets of (pattern, ids)."""

    def __init__(self, patterns: dict[str, set[int]], block: int = B):
        self.m = m = min(map(len, patterns))
        self.block = b = min(block, m)
        self.jump = m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, str, set[int]]]] = {}
        for pattern, ids in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                if m - end < self.shift.get(key, self.jump):
                    self.shift[key] = m - end
            self.bucket.setdefault(pattern[m - b : m], []).append((pattern[:b], pattern, ids))

    def search(self, text: str) -> set[int]:
        """Ids of all items with a pattern in ``text``."""
        found: set[int] = set()
        b, m, jump, shift = self.block, self.m, self.jump, self.shift.get
        at, n = m, len(text)
        while at <= n:
            key = text[at - b : at]
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - m
            head = text[start : start + b]
            for first, pattern, ids in self.bucket.get(key, ()):
                if first == head and text.startswith(pattern, start):
                    found |= ids
            at += 1
        return found


def _groups(items: DataFrame, words: int, group_patterns: int) -> Iterator[list[tuple[int, str]]]:
    """Items with windows, in groups; one group at a time is held."""
    group, held = [], 0
    texts = items.filter(F.col("text").isNotNull()).select("item_id", normal_words(F.col("text")).alias("words"))
    for item_id, text in texts.toLocalIterator():
        n = max(0, text.count(" ") - words)
        if n and held + n > group_patterns and group:
            yield group
            group, held = [], 0
        if n:
            group.append((item_id, text))
            held += n
    if group:
        yield group


def leaked(documents: DataFrame, items: DataFrame, words: int = 13, group_patterns: int = 200_000) -> DataFrame:
    """(doc_id, item_id): documents holding at least ``words`` consecutive words of an item."""
    spark = documents.sparkSession
    docs = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), normal_words(F.col("text")).alias("words")).filter(F.length("words") > 2 * words)
    shared = [spark.sparkContext.broadcast(group) for group in _groups(items, words, group_patterns)]
    if not shared:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")

    def machines() -> Iterator[WuManber]:
        for group in shared:
            yield WuManber(windows(group.value, words))
            del group._value  # loaded again when its turn comes

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = next(machines()) if len(shared) == 1 else None

        def search(held: list[pd.DataFrame]) -> pd.DataFrame:
            rows = [(d, i) for machine in ([only] if only else machines()) for part in held for d, text in zip(part["doc_id"], part["words"]) for i in machine.search(text)]
            return pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

        held, size = [], 0
        for part in parts:
            held.append(part)
            size += int(part["words"].str.len().sum())
            if only or size >= TEXTS_AT_ONCE:
                yield search(held)
                held, size = [], 0
        if held:
            yield search(held)

    return docs.mapInPandas(find, "doc_id bigint, item_id bigint")

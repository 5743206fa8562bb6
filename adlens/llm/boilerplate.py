"""Page boilerplate found by differencing pages of near URLs.

Pages of all sources are sorted by (host, path, url). Each page is paired with the nearest pages of its host on either side,
their lines are aligned by longest common subsequence, and aligned lines are shared lines. Over the pages of a host each line
gets its share, the part of its pairings in which it was aligned; lines from ``least_share`` are template lines. Around them
lie lines that templates fill in: path lines made of template parts, and the entries below a lead-in (a template line that,
after the start of the main body, is mostly followed by a title-like line that is no template line). Short lines among template lines at a page's ends go with them, and short lines that
mostly are template lines where they occur, over all hosts, count as such everywhere. In markup, whole blocks
are decided: a block with headings or sentences of its own is main body, any other is not.

Lines are compared by their ASCII letters in lower case, numbers as one symbol, so that garbled copies still align.

Defined cases: null texts and rows without url give no row; empty lines show no text and give no row; a page alone on its host
has no template lines; equal pages and versions of one page are not paired with each other, but each distinct
text of a page is paired with a text of each page near it; empty tables give no rows; ids are taken as unique within a source.
Every text is read once, where it is scanned, into the hashes of its lines, and only these are moved. Distinct texts are held in blocks
of ``BLOCK`` of the sorted order, each with those of other blocks that they are paired with; counts are summed over the whole host, so
a host or page of any size never gathers in one task and block borders do not matter.
"""

from __future__ import annotations

import marshal
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.markup import shown_lines
from adlens.operators.snapshot_diff import normal_url
from adlens.session import written

BLOCK = 500
NEIGHBOURS = 3
#: Characters of lines that a task holds to read each only once.
ROOM = 20_000_000
#: Flags of a line: a sentence, like a title, begins with a small letter or a figure, ends a sentence.
SENTENCE, TITLE, LOWER, FIGURE, STOP = 1, 2, 4, 8, 16
_FOLD = bytes(32 if chr(c).isspace() else 48 if chr(c).isdigit() else ord(chr(c).lower()) for c in range(128)) + bytes(128)
_FIGURES = re.compile("[0-9]+")
_THREE_WORDS = re.compile(rb"[a-z][^a-z]+[a-z]+[^a-z]+[a-z]")
_PARTS = re.compile(r"\s+(?:[^\x00-\x7f]+|[|/>&*-]|[^\x00-\x7f]*[|/>])\s+|\s{2,}")
_BETWEEN = re.compile(rb" [|/>&*-] ")
_HEADING = re.compile(r"(?i)<h[1-3]\b")
_BOX = re.compile(r"(?i)<(/?)(div|section|header|footer|nav|aside|main|article|table|tr|td|ul|ol|form|body)\b([^>]*)>")
_CLASS = re.compile(r"(?i)\bclass\s*=\s*[\"']?([^\"'>]*)")


def _plain(line: str) -> bytes:
    """ASCII characters of a line in lower case, white space as spaces, every figure as 0."""
    return line.encode("ascii", "ignore").translate(_FOLD)


def line_key(line: str, plain: bytes | None = None) -> bytes:
    """Key under which lines are compared; empty for lines without any letter or digit."""
    low = b" ".join((_plain(line) if plain is None else plain).split())
    if not low:
        return " ".join(line.lower().split()).encode()
    if b"0" not in low:
        return low
    if b"(" in low or _THREE_WORDS.search(low):
        while b"00" in low:
            low = low.replace(b"00", b"0")
        return low
    return b" ".join(line.encode("ascii", "ignore").lower().split())


def line_hash(line: str, plain: bytes | None = None) -> int:
    """64 bits of a line's key, the same in every process."""
    return xxhash.xxh3_64_intdigest(line_key(line, plain)) - (1 << 63)


def common_lines(a: list, places: dict) -> list:
    """Keys of a longest common subsequence of ``a`` and the text whose keys stand at ``places`` (positions descending)."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[tuple[int, int]] = []
    for i, key in enumerate(a):
        for j in places.get(key, ()):
            if not tails or j > tails[-1]:
                back.append((i, ends[-1] if ends else -1))
                tails.append(j)
                ends.append(len(back) - 1)
            else:
                at = bisect_left(tails, j)
                back.append((i, ends[at - 1] if at else -1))
                tails[at], ends[at] = j, len(back) - 1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(a[back[k][0]])
        k = back[k][1]
    return out


def _flags(line: str) -> int:
    spaces, first, last = line.count(" "), line[0], line[-1]
    sentence = spaces >= 9 or (spaces >= 4 and last in ".!?…”“»")
    lower, figure = first.islower(), first.isdigit()
    title = not (sentence or lower or figure or last in ".!?;,")
    return sentence * SENTENCE | title * TITLE | lower * LOWER | figure * FIGURE | (last in ".!?") * STOP


class Known:
    """What was read of lines (hash, flags, parts), of parts (hash) and of lines of markup (boxes begun or ended, the last of them).

    It is forgotten whenever ``ROOM`` characters are held, so that texts of any number can be read with it.
    """

    __slots__ = ("lines", "marks", "parts", "room")

    def __init__(self):
        self.lines: dict[str, tuple[int, int, tuple[int, ...]]] = {}
        self.parts: dict[str, int] = {}
        self.marks: dict[str, tuple[int, str]] = {}
        self.room = ROOM

    def keep(self, of: dict, text: str, value):
        if len(text) < 1000:
            self.room -= len(text) + 50
            if self.room < 0:
                self.lines, self.parts, self.marks, self.room = {}, {}, {}, ROOM
            else:
                of[text] = value
        return value

    def line(self, line: str) -> tuple[int, int, tuple[int, ...]]:
        """(hash, flags, hashes of its parts where it has several)."""
        plain, parts = _plain(line), ()
        # A line without a sign between spaces has one part; signs beyond ASCII leave two spaces.
        if b"  " in plain or "\xa0" in line or _BETWEEN.search(plain):
            parts = _PARTS.split(line)
            parts = tuple([self.parts.get(x) or self.keep(self.parts, x, line_hash(x)) for x in parts]) if len(parts) > 1 else ()
        return self.keep(self.lines, line, (line_hash(line, plain), _flags(line), parts))

    def boxes(self, line: str) -> tuple[int, str]:
        """How many boxes begin or end in a line of markup, and what the last of them leaves open."""
        n, box = 0, ""
        for m in _BOX.finditer(line):
            n += 1
            c = _CLASS.search(m[3])
            box = "" if m[1] else f"{m[2].lower()}.{_FIGURES.sub('', c[1]) if c else ''}"
        return self.keep(self.marks, line, (n, box))


class Page:
    """Visible lines of a text: their places, hashes, flags and parts, and the blocks of markup that hold them."""

    __slots__ = ("at", "boxes", "copies", "flags", "heads", "host", "keys", "number", "off", "parts", "places")

    @classmethod
    def read(cls, text: str, markup: bool, known: Known) -> Page:
        page = cls()
        raw = text.split("\n")
        page.boxes = page.heads = None
        if markup:
            box, number = "", 0
            page.at, page.boxes, page.heads, lines = [], [], [], []
            for i, (line, seen) in enumerate(zip(raw, shown_lines(text))):
                if seen:
                    lines.append(seen)
                    page.at.append(i)
                    page.boxes.append((number, box))
                    page.heads.append(_HEADING.search(line) is not None)
                elif "<" in line:
                    n, last = known.marks.get(line) or known.boxes(line)
                    if n:
                        number, box = number + n, last
        else:
            lines = [x.strip() for x in raw]
            page.at = [i for i, x in enumerate(lines) if x]
            lines = [lines[i] for i in page.at]
        found = [known.lines.get(x) or known.line(x) for x in lines]
        page.keys, page.flags = [x[0] for x in found], bytes([x[1] for x in found])
        page.parts = {i: x[2] for i, x in enumerate(found) if x[2]}
        return page

    def packed(self) -> bytes:
        return marshal.dumps((array("i", self.at).tobytes(), array("q", self.keys).tobytes(), self.flags, self.parts, self.boxes, self.heads))

    @classmethod
    def unpacked(cls, number: int, host: str, copies: int, blob: bytes) -> Page:
        page = cls()
        page.number, page.host, page.copies = number, host, copies
        at, keys, page.flags, page.parts, page.boxes, page.heads = marshal.loads(blob)
        page.at, page.keys = array("i", at).tolist(), array("q", keys).tolist()
        return page

    def place(self) -> None:
        self.places = {}
        for j in range(len(self.keys) - 1, -1, -1):
            self.places.setdefault(self.keys[j], []).append(j)


class HostTemplates:
    """Template lines of a host, their parts, and its lead-ins, as hashes of keys."""

    def __init__(self):
        self.lines: set[int] = set()
        self.parts: set[int] = set()
        self.leads: set[int] = set()

    def leads_of(self, page: Page) -> Iterator[tuple[int, bool]]:
        """Template lines after the main body's start that may be lead-ins, and whether an entry follows."""
        keys = page.keys
        for i in range(self.start(page) + 1, len(keys) - 1):
            if keys[i] in self.lines and keys[i - 1] not in self.lines:
                yield keys[i], keys[i + 1] not in self.lines and bool(page.flags[i + 1] & TITLE)

    def is_path(self, page: Page, i: int) -> bool:
        parts = page.parts.get(i)
        if not parts or len(parts) < 3 or page.flags[i] & STOP:
            return False
        return sum(h in self.parts or h in self.lines for h in parts) >= min(2, len(parts) - 1)

    def start(self, page: Page) -> int:
        for i, key in enumerate(page.keys):
            if key not in self.lines and not self.is_path(page, i):
                return i
        return len(page.keys)

    def plain_off(self, page: Page) -> list[bool]:
        """Template and path lines, and short lines that stand among them before or after the main body."""
        keys, flags = page.keys, page.flags
        off = [k in self.lines or self.is_path(page, i) for i, k in enumerate(keys)]
        n = len(off)
        for i in range(min(n - 2, 6)):  # a title is not followed by template lines only
            if off[i]:
                continue
            if flags[i] & SENTENCE or not (off[i + 1] and off[i + 2]):
                break
            off[i] = True
        last = max((i for i in range(n) if not off[i] and flags[i] & SENTENCE), default=n)
        for i in range(last + 1, n):
            if not off[i] and off[i - 1] and keys[i - 1] not in self.leads and (i + 1 == n or off[i + 1]) and not flags[i] & LOWER and i >= 2 and off[i - 2] and keys[i - 2] not in self.leads:
                off[i] = True
        return off

    def outside(self, page: Page) -> list[int]:
        """Positions of the lines outside the main body."""
        keys, flags = page.keys, page.flags
        off = list(page.off)
        start = next((i for i, x in enumerate(off) if not x), len(off))
        led = [i for i in range(start + 1, len(keys)) if keys[i] in self.leads]
        for i in led:
            last = i == led[-1]
            later = any(flags[j] & SENTENCE and not off[j] for j in range(i + 1, len(keys)))
            j = i + 1
            while j < len(keys) and not off[j] and flags[j] & TITLE:
                off[j] = True
                j += 1
                if later or not last:  # between parts of the main body a lead-in has one entry
                    break
        if page.boxes:
            off = self._by_box(page, off)
        return [i for i, x in enumerate(off) if x]

    @staticmethod
    def _is_list(page: Page, at: list[int], off: list[bool]) -> bool:
        """A block of entries in lower case or with figures, none of them known, continues the main body."""
        return not any(off[i] for i in at) and any(page.flags[i] & (LOWER | FIGURE) for i in at)

    def _by_box(self, page: Page, off: list[bool]) -> list[bool]:
        boxes: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, box in enumerate(page.boxes):
            boxes[box].append(i)
        if len(boxes) < 2:
            return [x and not h for x, h in zip(off, page.heads)]
        own = {b: any(page.heads[i] or (page.flags[i] & SENTENCE and not off[i]) for i in at) or self._is_list(page, at, off) for b, at in boxes.items()}
        titled = {b[1] for b, main in own.items() if main and any(page.heads[i] for i in boxes[b])}
        other = {b[1] for b, main in own.items() if not main and all(off[i] for i in boxes[b])}
        out = list(off)
        for box, at in boxes.items():
            main = own[box] or (box[1] in titled - other)
            for i in at:
                out[i] = not main
        return out


WHOLE = 1 << 24
_COUNTS = "host string, key bigint, met bigint, aligned bigint, met_whole bigint, aligned_whole bigint, parts array<bigint>"
_KINDS = "what int, number bigint, at array<int>, keys array<bigint>, n array<bigint>, known array<bigint>"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def read_pages(rows: DataFrame) -> DataFrame:
    """(src, rec_id, host, page, digest, packed): each text as its lines' hashes; equal texts of a page have one digest."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known()
        for part in parts:
            marked = (part["src"] == "pages").tolist()
            texts, pages = part["text"].tolist(), part["page"].tolist()
            digests = [xxhash.xxh3_128_digest(f"{p}\n{m}\n{t}".encode("utf-8", "surrogatepass")) for t, m, p in zip(texts, marked, pages)]
            blobs = [Page.read(t, m, known).packed() for t, m in zip(texts, marked)]
            yield part.drop(columns="text").assign(digest=digests, packed=blobs)

    return rows.select("src", "rec_id", "host", "page", "text").mapInPandas(read, "src string, rec_id bigint, host string, page string, digest binary, packed binary")


_SUMS = ["met", "aligned", "met_whole", "aligned_whole"]


def _summed(found: list[tuple[str, tuple[int, int, int, int], list[int]]]) -> pd.DataFrame:
    """Counts by (host, key), from (host, counts of each key, keys)."""
    hosts, codes = np.unique(np.array([x[0] for x in found], object), return_inverse=True)
    sizes = np.array([len(x[2]) for x in found], np.int64)
    rows = pd.DataFrame({"host": np.repeat(codes, sizes), "key": np.fromiter(chain.from_iterable(x[2] for x in found), np.int64, sizes.sum())})
    rows[_SUMS] = np.repeat(np.array([x[1] for x in found], np.int64).reshape(-1, 4), sizes, axis=0)
    rows = rows.groupby(["host", "key"], sort=False, as_index=False).sum()
    return rows.assign(host=hosts[rows["host"].to_numpy(np.int64)])


def _compared(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Counts of lines over the block's pairings, by host: met, aligned, and both with each pair of pages counting ``WHOLE`` in all."""
    pages: dict[int, Page] = {}
    for number, host, packed in zip(texts["number"], texts["host"], texts["packed"]):
        page = pages[number] = Page.unpacked(number, host, 1, packed)
        page.place()
    met, weights, sums, found, held = Counter(), Counter(), [], [], 0

    def count(host: str, counts: tuple[int, int, int, int], keys: list[int]) -> None:
        nonlocal held
        found.append((host, counts, keys))
        held += len(keys)
        if held > 500_000:
            sums.append(_summed(found))
            found.clear()
            held = 0

    for a, b, weight in zip(pairs["a"], pairs["b"], pairs["weight"]):
        page, other = pages[a], pages[b]
        same = common_lines(page.keys, other.places)
        if len(same) >= 0.9 * min(len(page.keys), len(other.keys)):  # a copy or a version of the page
            continue
        for x in (a, b):  # one pairing for both pages
            met[x] += 1
            weights[x] += weight
        count(page.host, (0, 2, 0, 2 * weight), list(set(same)))
    for x, n in met.items():
        count(pages[x].host, (n, 0, weights[x], 0), list(pages[x].places))
    rows = pd.concat([*sums, _summed(found)], ignore_index=True)
    if sums:
        rows = rows.groupby(["host", "key"], sort=False, as_index=False).sum()
    parts = {(p.host, p.keys[i]): list(x) for p in pages.values() for i, x in p.parts.items()}
    return rows.assign(parts=[parts.get(x) for x in zip(rows["host"].tolist(), rows["key"].tolist())])


def _over_blocks(single: DataFrame, known: DataFrame, step: Callable[[HostTemplates, list[Page]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``step`` over the pages of each block and host, with what is known of the host: (host, what, key)."""

    def find(pages: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        templates: dict[str, HostTemplates] = defaultdict(HostTemplates)
        for host, what, key in zip(facts["host"], facts["what"], facts["key"]):
            (templates[host].lines, templates[host].parts, templates[host].leads)[what].add(key)
        hosts: dict[str, list[Page]] = defaultdict(list)
        for number, host, copies, packed in zip(pages["number"], pages["host"], pages["copies"], pages["packed"]):
            hosts[host].append(Page.unpacked(number, host, copies, packed))
        return _frame([x for host, own in hosts.items() for x in step(templates[host], own)], schema)

    blocks = single.select(F.col("block").alias("block"), F.col("host").alias("host")).distinct()
    facts = blocks.join(known, "host").select(F.col("block").alias("block"), F.col("host").alias("host"), "what", "key")
    return single.select("block", "number", "host", "copies", "packed").groupBy("block").cogroup(facts.groupBy("block")).applyInPandas(find, schema)


def _leads(templates: HostTemplates, pages: list[Page]) -> Iterator[tuple[str, int, int, int]]:
    seen, led = Counter(), Counter()
    for page in pages:
        for key, entry in templates.leads_of(page):
            seen[key] += page.copies
            led[key] += page.copies * entry
    return ((pages[0].host, key, n, led[key]) for key, n in seen.items())


def _kinds(templates: HostTemplates, pages: list[Page]) -> Iterator[tuple]:
    """What 0: the lines outside the main body of each text; 1: how often lines occur and are template lines; 2: lines of a text left open."""
    seen, known = Counter(), Counter()
    for page in pages:
        page.off = templates.plain_off(page)
        outside = templates.outside(page)
        boxed = page.boxes is not None and len(set(page.boxes)) > 1
        keys, at, copies = page.keys, page.at, page.copies
        if outside:
            yield 0, page.number, np.array([at[i] for i in outside], np.int32), None, None, None
        for i in outside:
            seen[keys[i]] += copies
            if page.off[i]:
                known[keys[i]] += copies
        rest = set(outside)
        left = [i for i, flags in enumerate(page.flags) if not flags & SENTENCE and i not in rest]
        for i in left:
            seen[keys[i]] += copies
        if left and not boxed:
            yield 2, page.number, np.array([at[i] for i in left], np.int32), np.array([keys[i] for i in left], np.int64), None, None
    yield 1, 0, None, np.fromiter(seen, np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)), np.array([known[x] for x in seen], np.int64)


def _numbered(parts: DataFrame, part: str, offset: str) -> DataFrame:
    """Rows before each part, from (part, n)."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset)))


def _pairs(texts: DataFrame, neighbours: int) -> DataFrame:
    """(block, a, b, weight): pairings of the pages of ``texts`` (number, host, page, part) with their next ``neighbours`` on the host."""
    pages = texts.groupBy("host", "page").agg(F.min("number").alias("first"), F.min("part").alias("part"), F.count("*").alias("n"))
    pages = pages.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    starts = _numbered(pages.groupBy("part").agg(F.count("*").alias("n")), "part", "offset")
    pages = written(pages.join(starts, "part").select("host", "first", "n", (F.col("rank") + F.col("offset")).alias("rank")))
    left = pages.select("host", F.col("first").alias("a"), F.col("n").alias("n_a"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + neighbours)).alias("rank"))
    near = left.join(pages.select("host", "rank", F.col("first").alias("b"), F.col("n").alias("n_b")), ["host", "rank"])
    # The texts of both pages go side by side, the last one of the page with fewer beside all later ones; the longer side's block has them.
    most = F.greatest("n_a", "n_b")
    near = near.select("*", F.expr(f"{WHOLE} DIV greatest(n_a, n_b)").alias("weight"), F.explode(F.sequence(F.lit(0).cast("bigint"), most - 1)).alias("v"))
    near = near.select("n_a", "n_b", "weight", (F.col("a") + F.least("v", F.col("n_a") - 1)).alias("a"), (F.col("b") + F.least("v", F.col("n_b") - 1)).alias("b"))
    return near.select(F.expr(f"if(n_a >= n_b, a, b) DIV {BLOCK}").alias("block"), "a", "b", F.greatest("weight", F.lit(1)).alias("weight"))


def boilerplate_lists(texts: DataFrame, neighbours: int = NEIGHBOURS, least_share: float = 0.25) -> DataFrame:
    """(src, rec_id, line_nos): the visible lines outside the main body of ``texts`` (src, rec_id, text, url), in one or more rows a text."""
    rows = texts.filter(F.col("text").isNotNull() & F.col("url").isNotNull()).select("src", "rec_id", "text", normal_url(F.col("url")).alias("page"))
    rows = rows.select("src", "rec_id", "text", F.regexp_replace("page", r"^[^/]*//|\.html?$|/+$", "").alias("page"))
    read = written(read_pages(rows.select("src", "rec_id", "text", F.regexp_replace(F.split("page", "/", 2)[0], r"^www\.", "").alias("host"), "page")))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Distinct texts of each page, numbered through in the order of host and page.
    single = read.groupBy("digest").agg(F.min(F.struct("src", "rec_id")).alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("host", "page", "packed")))
    ordered = single.repartitionByRange(parts, "host", "page", "id").sortWithinPartitions("host", "page", "id").withColumn("at", F.monotonically_increasing_id())
    single = written(ordered.select("digest", "host", "page", "copies", "packed", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")))
    starts = _numbered(single.groupBy("part").agg(F.count("*").alias("n")), "part", "offset")
    single = single.join(starts, "part").withColumn("number", F.col("at") + F.col("offset")).withColumn("block", F.expr(f"number DIV {BLOCK}"))
    # Each block gets its own texts and those of other blocks that they are paired with.
    pairs = written(_pairs(single.select("number", "host", "page", "part"), neighbours))
    guests = pairs.select("block", F.explode(F.array("a", "b")).alias("number")).filter(F.expr(f"number DIV {BLOCK} <> block")).distinct()
    columns = ["block", "number", "host", "packed"]
    held = single.select(*columns).unionByName(single.drop("block").join(guests, "number").select(*columns))
    counts = held.groupBy("block").cogroup(pairs.groupBy("block")).applyInPandas(_compared, _COUNTS)
    counts = counts.groupBy("host", "key").agg(*(F.sum(x).alias(x) for x in ("met", "aligned", "met_whole", "aligned_whole")), F.max("parts").alias("parts"))
    # Two pairings, or one where the pages that hold the line have no other (each pairing counts for both of its pages).
    least_pairs = F.least(F.lit(4), F.col("met"))
    lines = written(counts.filter((F.col("aligned") >= least_pairs) & (F.col("aligned_whole") >= least_share * F.col("met_whole"))).select("host", "key", "parts"))
    known = lines.select("host", F.lit(0).alias("what"), "key").unionByName(lines.select("host", F.lit(1).alias("what"), F.explode("parts").alias("key")).distinct())
    leads = _over_blocks(single, known, _leads, "host string, key bigint, seen bigint, led bigint").groupBy("host", "key").agg(F.sum("seen").alias("seen"), F.sum("led").alias("led"))
    leads = written(leads.filter((F.col("led") >= 2) & (F.col("led") >= 0.6 * F.col("seen"))).select("host", F.lit(2).alias("what"), "key"))
    kinds = written(_over_blocks(single, known.unionByName(leads), _kinds, _KINDS))
    # Lines that mostly are template lines where they occur are so on pages, too, whose neighbours lack them.
    counted = kinds.filter("what = 1").select(F.inline(F.arrays_zip(F.col("keys").alias("key"), "n", "known")))
    usual = counted.groupBy("key").agg(F.sum("known").alias("known"), F.sum("n").alias("n")).filter((F.col("known") >= 3) & (F.col("known") >= 0.5 * F.col("n"))).select("key")
    left = kinds.filter("what = 2").select("number", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("at").alias("line_no"))))
    out = kinds.filter("what = 0").select("number", "at").unionByName(left.join(usual, "key", "left_semi").select("number", F.array("line_no").alias("at")))
    named = out.join(single.select("number", "digest"), "number").select("digest", F.col("at").alias("line_nos"))
    return read.select("src", "rec_id", "digest").join(named, "digest").select("src", "rec_id", "line_nos")


def boilerplate(texts: DataFrame, neighbours: int = NEIGHBOURS, least_share: float = 0.25) -> DataFrame:
    """(src, rec_id, line_no) of the visible lines outside the main body of ``texts`` (src, rec_id, text, url)."""
    return boilerplate_lists(texts, neighbours, least_share).select("src", "rec_id", F.explode("line_nos").alias("line_no"))

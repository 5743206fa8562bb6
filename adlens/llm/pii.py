"""Personal information in free text, by bootstrapped contextual extraction.

Candidates are cheap shapes: number and code runs, a capitalised street with a house number, pairs of capitalised words. Seeds
are those that need no context: numbers with a country prefix, identity numbers of a published form, streets with a street
type, and names whose parts stand in an email address of the same text. Candidates become a bipartite graph of instances (the shape of a
number, the street's words, the given name) and patterns (the words to the left). Spark scores it in rounds: a pattern's
score is the part of its mentions whose instances are accepted, an instance's the part that is seeded or stands in accepted
patterns; both need a least number of mentions. Accepted patterns accept unseen instances, and these new patterns;
strong ones accept any instance that is not overwhelmingly found elsewhere. Exact copies of a text count once. Email
addresses need no context.

Defined cases: null texts give no row and stay null when replaced; empty texts hold nothing; every occurrence counts; values
never overlap: of values that do, the heaviest stays, then the earliest and longest, emails before all others, and whatever overlaps
one that stays goes; repeated rows count each under their own id; empty tables give no rows. Texts and their lines are read whole at any
length: an address is tried at each of the ``REACH`` words before a house number (its grammar has at most five) and may end anywhere on
the line, a pattern is the last words however long, and a number may have any number of digits from ``LEAST_DIGITS``.
``support`` is the least number of observations behind a decision, whatever the size of the table.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import written

_UP = "A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻŒŠŽ"
_LOW = "a-zß-öø-ÿąćęłńóśźżœšž"
EMAIL = re.compile(r"(?i)(?<![\w.+-])[\w.+-]*\w(?: ?@ ?|\s?[\[(](?:at|@)[\])]\s?)(?:[\w-]+(?:\.|\s?[\[(]dot[\])]\s?))+[a-z]{2,}(?![\w])")
NUMBER = re.compile(r"(?<![\w@#/+.,:=-])(?<!\d )(?:\+|\()?\d+\)?(?:(?:[ .\-/]| ?\(0\) ?)?\(?\d+\)?)+(?![\w@])|(?<==)\+?\(?\d+\)?(?:(?:[ .\-/]| ?\(0\) ?)?\(?\d+\)?)+(?![\w@])")
CODE = re.compile(r"(?<![\w@#-])(?:[A-Z]{2,3} ?\d\d ?\d\d ?\d\d(?: ?[A-Z])?|[A-Z]\d[A-Z]\d{5}[A-Z]\d|[A-Z]{1,3}[ -]?\d{6,9}[A-Z]?)(?![\w-])")
# Words that make a street name of what stands beside them.
STREET_BEFORE = r"(?:ul\.|ulica|ulicy|al\.|aleja|alei|os\.|osiedle|pl\.|plac)"
STREET_AFTER = r"(?:Street|Road|Lane|Close|Court|Avenue|Drive|Way|Place|Square|Terrace|Gardens|Crescent|Grove|Hill|Row|Walk|Mews|St\.?|Rd\.?|Ave\.?|Ln\.?)"
STREET_END = r"(?:straße|strasse|str\.|weg|allee|ring|gasse|platz|(?<!ä)ufer|damm|steig|chaussee|stieg)"
STREET_FRENCH = r"(?:rue|avenue|chemin|allée|impasse|boulevard|place|quai|route|cours|passage|square|sentier|ruelle|av\.|bd|ch\.)"
_W = f"[{_UP}][{_UP}{_LOW}’'-]*"
_HOUSE = r"\d{1,4}(?:[a-zA-Z](?![\w])| ?(?:bis|ter)\b)?"
#: What may follow street and house: flat, postal code and place.
_PLACE = re.compile(rf"(?:/\d+| (?:m\.|lok\.) ?\d+)?(?:(?:,| à| in) (?:(?:\d\d-\d{{3}}|\d{{5}}) )?{_W}(?:[ -]{_W})?(?: [A-Z]{{1,2}}\d\d? \d[A-Z]{{2}})?)?")
ADDRESS = re.compile(
    rf"(?<![\w])(?=[{_UP}0-9uaopUAOP])(?:"
    rf"(?P<pl>(?i:\b{STREET_BEFORE}) ?(?P<k1>{_W}(?: {_W}){{0,3}}) {_HOUSE}(?:/\d+)?)"
    rf"|(?P<en>(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?\b\d{{1,4}}[A-Z]? (?P<k2>{_W}(?: {_W}){{0,3}} {STREET_AFTER})(?![\w]))"
    rf"|(?P<de>\b(?P<k3>(?:{_W}[ -]){{0,2}}[{_UP}][{_LOW}{_UP}-]*{STREET_END}|(?:{_W}[ -]){{1,3}}(?i:straße|weg|allee|ring|gasse|platz)) {_HOUSE}(?![\w/]))"
    rf"|(?P<fr>\b\d{{1,4}}(?: ?(?:bis|ter|quater|[a-zA-Z]))?,? (?P<k4>(?i:{STREET_FRENCH}) (?:(?:de|du|des|la|le|les|l|d|de la)[ ’'])*(?:{_W}|d[’']{_W}|l[’']{_W})))"
    rf"|(?P<bare>(?<![\w-])(?P<k5>{_W}(?: {_W}){{0,2}}) \d{{1,3}}[a-z]?(?:/\d{{1,3}})?(?![\w])|(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?(?<![\w.,/-])\d{{1,3}}[A-Z]? (?P<k6>{_W}(?: {_W}){{0,2}}) {_W}))"
)
#: An address holds a number beside a capitalised word or a French street type.
_NEAR_NUMBER = re.compile(rf"[{_UP}][{_UP}{_LOW}’'.-]+ \d{{1,4}}(?![\d.,]*\d)|(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter|quater)|[a-zA-Z])?,? (?:[{_UP}]|(?i:{STREET_FRENCH})\b)")
_AT = re.compile(r"(?i)@|[\[(]at[\])]")
_NAME_TOKEN = re.compile(rf"(?<![\w@#.&’'-])(?:(?:(?<=[\s=(:;])|(?<!.))[{_UP}]\.(?=[ ][{_UP}])|[{_UP}][{_LOW}]+(?:[’'-][{_UP}]?[{_LOW}]+)*|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*)(?![\w@])")
#: Where an address may begin, and how many words before its number.
_BEGIN = re.compile(rf"(?<!\w)[{_UP}0-9uaop]")
REACH = 8
LEAST_DIGITS = 6
_CONTEXT = re.compile(r"\w+|[^\w ]")
_PLAIN = str.maketrans("łŁøØđĐ", "lLoOdD")


@lru_cache(100_000)
def folded(word: str) -> str:
    word = word.lower().translate(_PLAIN).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def left_of(text: str, at: int, words: int = 2) -> str:
    """The last words and signs before ``at``, new lines as one sign, numbers as 0."""
    width = 40
    while True:
        left = text[max(0, at - width) : at]
        tokens = _CONTEXT.findall(left.replace("\n", " ⏎ ").lower())
        if len(tokens) > words or width >= at:
            break
        width *= 8
    tokens = tokens[-words:]
    return " ".join("0" if t.isdigit() else t for t in tokens)


def number_shape(value: str) -> str:
    return "".join("0" if c.isdigit() else "A" if c.isalpha() else c for c in value)


def _is_identity(value: str) -> bool:
    """Published forms of identity numbers that are no telephone numbers."""
    return bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{3} ?\d{6}|[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d\d|2[AB]) ?\d{3} ?\d{3} ?\d\d", value)) or (value.isdigit() and len(value) == 11 and _pesel(value))


def _pesel(value: str) -> bool:
    digits = list(map(int, value))
    return (10 - sum(d * w for d, w in zip(digits, (1, 3, 7, 9) * 2 + (1, 3)))) % 10 == digits[10]


def _addresses(text: str) -> Iterator[re.Match]:
    """Address shapes on the lines of numbers that may be house numbers, from left to right, none within another."""
    done = line = end = 0
    for hit in _NEAR_NUMBER.finditer(text):
        if hit.end() <= done:
            continue
        if hit.end() > end or not end:
            line, end = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.end())
            end = len(text) if end < 0 else end
        first = max(done, line)
        start = hit.start()
        for _ in range(REACH):
            if start <= first:
                break
            start = text.rfind(" ", first, start - 1) + 1 or first
        at = max(first, start)
        while at < hit.end():
            begin = _BEGIN.search(text, at, hit.end())
            if begin is None:
                break
            m = ADDRESS.match(text, begin.start(), end)
            if m is None:
                at = begin.end()
            else:
                yield m
                at = done = m.end()


def _mentions(text: str) -> list[tuple]:
    """(kind, start, end, instance, pattern, seed) of one text; kind 'number' is decided later."""
    out = []
    emails = [(m.start(), m.end()) for m in EMAIL.finditer(text)] if _AT.search(text) else []
    out += [("email", a, b, "", "", 1) for a, b in emails]
    locals_ = list(dict.fromkeys(re.split(r"@|[\[(\s]", text[a:b].strip(), maxsplit=1)[0].lower() for a, b in emails))
    taken = list(emails)

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b,))  # values taken don't overlap, so that the last one before b ends last
        return not i or taken[i - 1][1] <= a

    for m in _addresses(text):
        a, b = m.span()
        kind = m.lastgroup if m.lastgroup in ("pl", "en", "de", "fr", "bare") else next(k for k in ("pl", "en", "de", "fr", "bare") if m.group(k))
        b = _PLACE.match(text, b).end()
        key = folded(next(m.group(k) for k in ("k1", "k2", "k3", "k4", "k5", "k6") if m.group(k)))
        if kind == "en":  # the street's name without its type: other types may follow it
            key = key.rsplit(" ", 1)[0]
        if free(a, b):
            out.append(("address", a, b, key, left_of(text, a), int(kind != "bare")))
            if kind != "bare":
                insort(taken, (a, b))
    for m in NUMBER.finditer(text):
        value, (a, b) = m.group(), m.span()
        if value[0] == "(" and value[-1] == ")" and value.count("(") == 1:  # a number in brackets, not an area code
            value, a, b = value[1:-1], a + 1, b - 1
        digits = sum(c.isdigit() for c in value)
        if digits >= LEAST_DIGITS and free(a, b):
            phone = digits <= 15 and (value[0] == "+" and digits >= 9 or value.startswith("00") and digits >= 12 and len(value) > digits)
            out.append(("number", a, b, number_shape(value), left_of(text, a), 1 if phone else 2 if _is_identity(value) else 0))
    for m in CODE.finditer(text):
        if free(*m.span()):
            out.append(("number", m.start(), m.end(), number_shape(m.group()), left_of(text, m.start()), 2 if _is_identity(m.group()) else 0))
    tokens = list(_NAME_TOKEN.finditer(text))
    for k in range(len(tokens) - 1):
        t1, t2 = tokens[k], tokens[k + 1]
        gap, last = text[t1.end() : t2.start()], t2
        if gap != " " and gap != ", ":
            continue
        one, two = t1.group(), t2.group()
        if two[-1] == "." or (one[-1] == "." and gap == ", "):  # an initial comes first or in the middle
            if gap != " " or k + 2 >= len(tokens) or two[-1] != "." or one[-1] == "." or text[t2.end() : tokens[k + 2].start()] != " ":
                continue
            last = tokens[k + 2]
            two = last.group()
        if (one.isupper() and len(one) > 2) != (two.isupper() and len(two) > 2) and one[-1] != ".":
            continue
        a, b = t1.start(), last.end()
        if not free(a, b) or (one.isupper() and two.isupper() and text[b : b + 16].isupper()):  # a passage in capitals tells nothing
            continue
        given, surname = (two, one) if gap == ", " else (one, two)
        g, s = folded(given), folded(surname)
        seed = int(len(s) > 3 and any(s in x and (x[0] == g[0] or x.startswith(s)) for x in locals_))
        if not seed and locals_ and len(g) > 2 and g[-1] != ".":
            seed = int(any(re.split(r"[+._\d-]", x)[0] == g for x in locals_))
        out.append(("name", a, b, "." if g[-1] == "." else g, left_of(text, a), seed, s))
    return [x if len(x) == 7 else (*x, "") for x in out]


def mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_at, end_at, instance, pattern, seed, surname) of all candidates."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, *m) for d, text in zip(part["doc_id"], part["text"]) for m in _mentions(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_at", "end_at", "instance", "pattern", "seed", "surname"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    return rows.mapInPandas(find, "doc_id bigint, kind string, start_at int, end_at int, instance string, pattern string, seed int, surname string")


def score_graph(edges: DataFrame, rounds: int, least_pattern: float, least_instance: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Accepted instances and patterns of ``edges`` (kind, instance, pattern, n, seeds), each with its score."""
    totals = edges.groupBy("kind", "instance").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
    instances = totals.filter((F.col("seeds") >= support) & (F.col("seeds") >= least_instance * F.col("n"))).select("kind", "instance", (F.col("seeds") / F.col("n")).alias("score"))
    patterns = None
    for _ in range(rounds):
        held = edges.join(instances.select("kind", "instance", F.lit(1).alias("ok")), ["kind", "instance"], "left")
        scored = held.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok") == 1, F.col("n")).otherwise(F.col("seeds"))).alias("hits"), F.count("*").alias("kinds"))
        patterns = written(scored.filter((F.col("hits") >= least_pattern * F.col("n")) & (F.col("hits") > support)).select("kind", "pattern", (F.col("hits") / (F.col("n") + 1)).alias("score")))
        held = edges.join(patterns.select("kind", "pattern", F.lit(1).alias("ok")), ["kind", "pattern"], "left")
        scored = held.groupBy("kind", "instance").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok") == 1, F.col("n")).otherwise(F.col("seeds"))).alias("hits"))
        instances = written(scored.filter((F.col("hits") >= least_instance * F.col("n")) & (F.col("hits") >= support)).select("kind", "instance", (F.col("hits") / (F.col("n") + 1)).alias("score")))
    return instances, patterns


def personal_information(documents: DataFrame, rounds: int = 3, least_pattern: float = 0.25, least_instance: float = 0.3, support: int = 2, least_odds: float = 0.4) -> DataFrame:
    """(doc_id, pii_kind, start_at, end_at) of every value found in ``documents`` (doc_id, text)."""
    # Each distinct text is read and counted once, so that copies change no score.
    keyed = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.md5("text").alias("digest"))
    single = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    copies = written(keyed.select("digest", F.col("doc_id").alias("copy_id")).join(single.select("digest", "doc_id"), "digest").select("doc_id", "copy_id"))
    found = written(mentions(single))
    # Numbers stand for two kinds; each kind is a graph of its own over the same mentions.
    numbers = found.filter("kind = 'number'")
    as_kinds = numbers.withColumn("kind", F.lit("phone")).withColumn("seed", (F.col("seed") == 1).cast("int")).unionByName(numbers.withColumn("kind", F.lit("id_number")).withColumn("seed", (F.col("seed") == 2).cast("int")))
    others = found.filter("kind IN ('name', 'address')")
    edges = written(as_kinds.unionByName(others).groupBy("kind", "instance", "pattern").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds")))
    instances, patterns = score_graph(edges, rounds, least_pattern, least_instance, support)
    scored = edges.join(patterns.withColumnRenamed("score", "p_score"), ["kind", "pattern"], "left").fillna(0.0, ["p_score"])
    totals = scored.groupBy("kind", "instance").agg((F.sum(F.when(F.col("p_score") > 0, F.col("n")).otherwise(F.col("seeds"))) / F.sum("n")).alias("share"))
    totals = totals.join(instances.withColumnRenamed("score", "i_score"), ["kind", "instance"], "left").fillna(0.0, ["i_score"])
    scored = scored.join(totals, ["kind", "instance"])
    # A strong pattern accepts an instance unless nearly all of its mentions stand elsewhere: the odds of both, at any table size.
    unseen = (F.col("p_score") >= 0.7) & (F.col("p_score") * F.col("share") >= least_odds * (1 - F.col("p_score")) * (1 - F.col("share")))
    good = F.when((F.col("kind") == "name") & (F.col("instance") == "."), F.col("p_score") > 0).otherwise((F.col("i_score") > 0) | unseen)
    # Every mention of an instance behind a pattern shares one decision, so that only pairs of both are joined to the mentions.
    decided = scored.filter(good | (F.col("seeds") > 0)).select("kind", "instance", "pattern", good.alias("good"), (F.col("i_score") + F.col("p_score")).alias("weight"))
    kept = as_kinds.unionByName(others).join(decided, ["kind", "instance", "pattern"]).filter(F.col("good") | (F.col("seed") > 0))
    kept = kept.select("doc_id", "kind", "start_at", "end_at", (2 * F.col("seed") + F.col("weight")).alias("weight"))
    kept = kept.unionByName(found.filter("kind = 'email'").select("doc_id", "kind", "start_at", "end_at", F.lit(9.0).alias("weight")))
    return apart(kept).join(copies, "doc_id").select(F.col("copy_id").alias("doc_id"), F.col("kind").alias("pii_kind"), "start_at", "end_at")


def apart(values: DataFrame) -> DataFrame:
    """(doc_id, kind, start_at, end_at): of overlapping values of a text (with weight) the heaviest, then those that overlap none kept before."""
    order = Window.partitionBy("doc_id").orderBy("start_at", "end_at", "kind")
    reach = F.max("end_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A run of values that overlap one another, directly or by others between them, is settled by itself.
    runs = values.withColumn("new", F.coalesce((reach <= F.col("start_at")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("lightness"), "start_at", (-F.col("end_at")).alias("back"), "kind")))
    held = runs.groupBy("doc_id", "run").agg(held.alias("held"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["start_at"] < -x["back"]) & (x["start_at"] < -k["back"]))
    kept = F.aggregate(F.slice("held", 2, F.size("held")), F.slice("held", 1, 1), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    single = F.when(F.size("held") == 1, F.col("held")).otherwise(kept)
    return held.select("doc_id", F.explode(single).alias("v")).select("doc_id", "v.kind", "v.start_at", (-F.col("v.back")).alias("end_at"))


def redacted(documents: DataFrame, **options) -> DataFrame:
    """``documents`` (doc_id, text) with each value replaced by ``<KIND>``; the rest of the text is unchanged."""
    spans = personal_information(documents, **options).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "pii_kind"))).alias("spans"))

    def replace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, own in zip(part["text"], part["spans"]):
                if text is not None and own is not None:
                    pieces, at = [], 0
                    for x in own:
                        pieces += [text[at : x["start_at"]], f"<{x['pii_kind'].upper()}>"]
                        at = x["end_at"]
                    text = "".join([*pieces, text[at:]])
                out.append(text)
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": out})

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.join(spans, "doc_id", "left").mapInPandas(replace, "doc_id bigint, text string")

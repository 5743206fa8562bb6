"""Visually identical texts brought to one form: ignorables, compatibility forms, look-alike letters.

A text loses its ignorable characters, is decomposed (NFKD), white space becomes single spaces, and every token becomes a
lattice: at each position the character itself and its look-alikes of other scripts. Viterbi finds each script's most
probable path under character bigrams counted over the reference texts; a path must keep to one script (digits, marks and
signs are of any). The best script wins, the token's own script on ties. The result is composed again (NFC).

Defined cases: null texts and null array elements give no row; empty texts stay empty and match nothing unless a reference
text is empty too; letter case and accents stay as they are; a token that no single script can spell stays as it is;
repeated rows count each under their own id; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that are drawn alike; a letter, then its look-alikes of other scripts.
ALIKE = (
    "aаαɑ", "bЬ", "cсϲ", "dԁ", "eеҽ", "gɡց", "hһհ", "iіιı", "jјϳյ", "kкκ", "lӏ", "mм", "nոռ", "oоοօ", "pрρ", "qԛզ", "rг", "sѕ", "uυսц", "vνѵ", "wԝա", "xхχ", "yуγ", "zᴢ", "ßβ",
    "AАΑ", "BВΒ", "CСϹ", "DᎠ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "RᎡ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YУΥҮ", "ZΖ",
)
_ALIKE: dict[str, str] = {}
for _row in ALIKE:
    for _c in _row:
        _ALIKE[_c] = _row

#: Default-ignorable characters besides those of category Cf.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
UNUSUAL = r"[^\x21-\x7e ]|  |^ | $"


@lru_cache(20_000)
def script(c: str) -> str:
    """LATIN, CYRILLIC, ... for letters, '' for what any script may hold."""
    if not c.isalpha():
        return ""
    return unicodedata.name(c, "").split(" ")[0]


def reduced(text: str) -> str:
    """Without ignorables, decomposed, white space single and not at the ends."""
    text = unicodedata.normalize("NFKD", IGNORABLE.sub("", text))
    return " ".join(IGNORABLE.sub("", text).split())


def count_bigrams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams: Counter = Counter()
    for part in parts:
        for text in part["text"]:
            for token in reduced(text).split(" "):
                grams.update(zip(f"\x02{token}", f"{token}\x03"))
    yield pd.DataFrame([(p, c, n) for (p, c), n in grams.items()], columns=["p", "c", "n"])


class Lattice:
    """Viterbi over look-alikes under bigrams of the reference texts."""

    def __init__(self, grams: list[tuple[str, str, int]]):
        self.pair = {(p, c): n for p, c, n in grams}
        self.left: Counter = Counter()
        for p, _, n in grams:
            self.left[p] += n
        self.kept: dict[str, str] = {}

    def _log(self, p: str, c: str) -> float:
        return math.log((self.pair.get((p, c), 0) + 1e-3) / (self.left.get(p, 0) + 1))

    def _best(self, token: str, of: str) -> tuple[float, str] | None:
        paths = {"\x02": (0.0, "")}
        for c in token:
            options = [x for x in _ALIKE.get(c, c) if script(x) in ("", of)] or ([c] if not script(c) else [])
            if not options:
                return None
            paths = {x: max((s + self._log(p, x), t + x) for p, (s, t) in paths.items()) for x in options}
        return max((s + self._log(p, "\x03"), t) for p, (s, t) in paths.items())

    def token(self, token: str) -> str:
        if token.isascii():
            return token
        known = self.kept.get(token)
        if known is not None:
            return known
        own = Counter(filter(None, map(script, token)))
        scripts = sorted({script(x) for c in token for x in _ALIKE.get(c, c)} - {""}, key=lambda s: (-own[s], s))
        found = [(best[0], -i, best[1]) for i, s in enumerate(scripts) if (best := self._best(token, s))]
        out = max(found)[2] if found else token
        if len(self.kept) < 200_000:
            self.kept[token] = out
        return out

    def canonical(self, text: str) -> str:
        return unicodedata.normalize("NFC", " ".join(map(self.token, reduced(text).split(" "))))


def reference_bigrams(reference: DataFrame) -> list[tuple[str, str, int]]:
    """Bigram counts of all reference texts; bounded by the square of the number of characters in use."""
    grams = reference.select("text").filter(F.col("text").isNotNull()).mapInPandas(count_bigrams, "p string, c string, n long")
    return [tuple(r) for r in grams.groupBy("p", "c").agg(F.sum("n").alias("n")).collect()]


def canonical_forms(texts: DataFrame, reference: DataFrame) -> DataFrame:
    """``texts`` (src, rec_id, pos, text) with its unusual texts' ``canonical``; texts of plain ASCII are their own form."""
    spark = texts.sparkSession
    grams = spark.sparkContext.broadcast(reference_bigrams(reference))

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(grams.value)
        for part in parts:
            own = {c: part[c].tolist() for c in ("src", "rec_id", "pos", "text")}
            yield pd.DataFrame(own | {"canonical": [lattice.canonical(t) for t in own["text"]]})

    rows = texts.select("src", "rec_id", "pos", "text").filter(F.col("text").isNotNull())
    odd = rows.filter(F.col("text").rlike(UNUSUAL)).mapInPandas(convert, "src string, rec_id bigint, pos int, text string, canonical string")
    return odd.unionByName(rows.filter(~F.col("text").rlike(UNUSUAL)).withColumn("canonical", F.col("text")))


def respelled(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(src, rec_id, pos, kw_id): texts that differ from a keyword's text but share its form."""
    forms = canonical_forms(texts, keywords).filter(F.col("canonical") != F.col("text"))
    named = keywords.select("kw_id", F.col("text").alias("canonical"))
    return forms.join(named, "canonical").select("src", "rec_id", "pos", "kw_id")

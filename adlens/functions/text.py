"""Text normalisers, tokens and n-grams as native column expressions.

Four normalisers exist because four consumers need different equalities: ``fold_terms`` (n-grams of search terms),
``fold_content`` (matching in page text), ``norm_keyword`` (keyword similarity) and ``slug`` (path names). Compatibility
decomposition is done by a ``translate`` table that is derived from the Unicode data of the running Python for the Latin,
Greek and Cyrillic blocks, ligatures, full-width forms and spaces; text in other scripts passes through unchanged.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose characters are decomposed: Latin-1 to Latin Extended-B, Latin Extended Additional, Greek, Cyrillic, Greek Extended, spaces, ligatures, full-width.
RANGES = ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x370, 0x3FF), (0x400, 0x4FF), (0x1F00, 0x1FFF), (0x2000, 0x200A), (0x202F, 0x202F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E))

# Letters without decomposition and what they fold to, for search terms.
TERM_LETTERS = {"ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ø": "o", "Ø": "o", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ð": "d", "þ": "th"}
# The further letters folded in page content.
CONTENT_LETTERS = TERM_LETTERS | {"Ð": "d", "Þ": "th", "ħ": "h", "Ħ": "h", "ı": "i", "İ": "i"}

# Words that make no n-gram by themselves (English, Polish), compared with folded tokens as they stand.
STOPWORDS = (
    "a an and are as at be by for from in into is it of on or the this that to with "
    "i w we z ze na do od po za o u ok ktory która które co czy to tak nie oraz lub albo "
    "ale jak gdzie kiedy dla bez pod nad przy ich jego jej sie się jest są być bardzo"
).split()


@lru_cache(8)
def _tables(letters: tuple[tuple[str, str], ...]) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): one-to-one replacements as two strings, one-to-many ones as pairs."""
    own = dict(letters)
    source, target, longer = [], [], []
    for low, high in RANGES:
        for point in range(low, high + 1):
            c = chr(point)
            to = own.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if to == c:
                continue
            if len(to) == 1:
                source.append(c)
                target.append(to)
            else:
                longer.append((c, to))
    return "".join(source), "".join(target), tuple(longer)


def _decomposed(col: Column, letters: dict[str, str]) -> Column:
    source, target, longer = _tables(tuple(letters.items()))
    out = F.translate(F.coalesce(col, F.lit("")), source, target)
    # Most texts hold none of the one-to-many characters; the chain runs only where one is seen.
    chain = out
    for c, to in longer:
        chain = F.replace(chain, F.lit(c), F.lit(to))
    out = F.when(out.rlike("[" + "".join(c for c, _ in longer) + "]"), chain).otherwise(out)
    return F.regexp_replace(out, r"\p{Mn}+", "")


def fold_terms(col: Column) -> Column:
    """Lower case without diacritics, for search terms. Null becomes ''."""
    return F.lower(_decomposed(col, TERM_LETTERS))


def fold_content(col: Column) -> Column:
    """As ``fold_terms`` with the further letters of page content."""
    return F.lower(_decomposed(col, CONTENT_LETTERS))


def norm_keyword(col: Column) -> Column:
    """Lower case first, marks off, single base letters of barred Latin letters, white space collapsed and trimmed."""
    barred = {c: b for c, b in _named_base_letters()}
    out = F.lower(F.coalesce(col, F.lit("")))
    source, target, longer = _tables(tuple(barred.items()))
    keep = {"ß", "æ", "œ", "ð", "þ", "ı"}
    source_kept = [(a, b) for a, b in zip(source, target) if a not in keep]
    out = F.translate(out, "".join(a for a, _ in source_kept), "".join(b for _, b in source_kept))
    chain = out
    for c, to in longer:
        if c not in keep:
            chain = F.replace(chain, F.lit(c), F.lit(to))
    out = F.when(out.rlike("[" + "".join(c for c, _ in longer if c not in keep) + "]"), chain).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\p{Mn}+", ""), r"(?U)\s+", " "))


@lru_cache(1)
def _named_base_letters() -> tuple[tuple[str, str], ...]:
    """Lower-case Latin letters 'x with stroke' and the like that have no decomposition, by their Unicode names."""
    out = []
    for low, high in RANGES[:2]:
        for point in range(low, high + 1):
            c = chr(point)
            words = unicodedata.name(c, "").split(" ")
            if c.islower() and unicodedata.normalize("NFKD", c) == c and words[:3] == ["LATIN", "SMALL", "LETTER"] and len(words) > 4 and len(words[3]) == 1 and words[4] == "WITH":
                out.append((c, words[3].lower()))
    return tuple(out)


def slug(col: Column, fallback: str = "item") -> Column:
    """Path-safe name: decomposed, marks off, everything but a-z and 0-9 as '-'; letters without decomposition count as others."""
    out = F.lower(_decomposed(col, {}))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def term_tokens(col: Column) -> Column:
    """Folded tokens of ASCII letters and digits."""
    return F.filter(F.split(fold_terms(col), "[^a-z0-9]+"), lambda t: t != "")


def keyword_tokens(col: Column) -> Column:
    """Tokens of letters and digits of all scripts in the keyword norm."""
    return F.regexp_extract_all(norm_keyword(col), F.lit(r"(?U)[^\W_]+"), 0)


def ngrams(tokens: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Contiguous n-grams as array<struct<ngram, n>>, sizes in the given order."""

    def of(n: int) -> Column:
        first = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        grams = F.transform(first, lambda i: F.struct(F.array_join(F.slice(tokens, i, n), " ").alias("ngram"), F.lit(n).alias("n")))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<struct<ngram:string,n:int>>"))

    return F.flatten(F.array(*[of(n) for n in sizes]))


def is_function_gram(ngram: Column, stopwords: list[str]) -> Column:
    """Whether every token is a stopword or of one character."""
    return F.forall(F.split(ngram, " "), lambda t: t.isin(*stopwords) | (F.length(t) == 1))


def word_count(col: Column) -> Column:
    """Words of letters only."""
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(?U)[^\W\d_]+"), 0))


def phrase_count(phrase: Column, text: Column) -> Column:
    """Non-overlapping whole-word occurrences of a phrase; its spaces match any white space. An empty phrase counts 0.

    Both sides are expected folded by ``fold_content``.
    """
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.regexp_replace(F.trim(phrase), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E\b"))
    return F.when(F.trim(phrase) == "", 0).otherwise(F.regexp_count(text, quoted))

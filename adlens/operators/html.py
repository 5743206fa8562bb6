"""Pages as rows of signals. One tokenisation of the markup feeds every view; rules over the signals are native expressions.

The views differ on purpose in what they skip and join: content matching skips drawings and keeps heading texts in the body; the
audit counts every visible word but no title; page text for monitoring breaks lines at blocks and drops dangling skips at the body.

Defined cases: null html gives a row with ``ok`` false and null signals; empty html gives empty signals; malformed markup never fails
a row; whole pages are read; equal pages are read each; extra columns are kept out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import fold_content, phrase_count
from adlens.session import written

# Words that make a link or button a call to action (English, Polish).
CTA_WORDS = (
    "buy", "buy now", "order", "order now", "add to cart", "add to basket", "shop now", "sign up", "signup", "subscribe", "get started", "get a quote", "request a quote", "book now", "book", "contact", "contact us", "call now",
    "download", "learn more", "try", "try now", "start", "checkout",
    "kup", "kup teraz", "kup online", "zamów", "zamów teraz", "dodaj do koszyka", "do koszyka", "zapisz się", "zapisz sie", "zamawiam", "kupuję", "kupuje", "kontakt", "skontaktuj się", "skontaktuj sie", "zadzwoń", "zadzwon",
    "pobierz", "wyceń", "wycen", "wyceń teraz", "zamów wycenę", "sprawdź", "sprawdz", "rezerwuj", "zarezerwuj", "wypróbuj", "wyprobuj", "dowiedz się", "dowiedz sie", "zacznij", "przejdź do kasy", "przejdz do kasy",
)


def _word_patterns(words: tuple[str, ...]) -> list[tuple[str, re.Pattern]]:
    """Each word with its pattern; the first that matches is the longest."""
    longest_first = sorted(set(words), key=lambda w: (-len(w), w))
    return [(w, re.compile(rf"\b{re.escape(w)}\b", re.IGNORECASE)) for w in longest_first]


_CTA = _word_patterns(CTA_WORDS)
# Block elements that end a line of page text.
_BLOCKS = frozenset("p div section article header footer li ul ol tr table br h1 h2 h3 h4 h5 h6 blockquote pre figure nav main aside".split())
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_AUDIT_WORD = re.compile(r"\b[\w'-]+\b")

START, END, TEXT = range(3)


class _Tokens(HTMLParser):
    """Markup as a flat list of (kind, name or text, attributes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.out.append((START, tag, {k: v for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        self.out.append((END, tag, None))

    def handle_data(self, data):
        self.out.append((TEXT, data, None))


def tokens(html: str) -> tuple[list[tuple], int]:
    """Tokens of a page and how many of them were certain before the end of input was known."""
    parser = _Tokens()
    parser.feed(html)
    sure = len(parser.out)
    parser.close()
    return parser.out, sure


def _flat(parts: list[str], glue: str = " ") -> str:
    return _SPACE.sub(" ", glue.join(parts)).strip()


def _visible(stream: list[tuple], skip: frozenset[str], reset: str | None = None) -> Iterator[tuple[tuple, bool]]:
    """Tokens with whether they are outside all ``skip`` elements; ``reset`` ends whatever was left open."""
    depth = 0
    for token in stream:
        kind, name, _ = token
        if kind == START and name == reset:
            depth = 0
        elif kind == START and name in skip:
            depth += 1
        elif kind == END and name in skip:
            depth = max(0, depth - 1)
        yield token, depth == 0


_CONTENT_SKIP = frozenset(("script", "style", "noscript", "template", "svg"))
_AUDIT_SKIP = frozenset(("script", "style", "noscript", "template", "title"))
_TEXT_SKIP = _CONTENT_SKIP | {"title"}


def content_view(stream: list[tuple]) -> dict:
    """Title, description, headings and readable text for matching phrases."""
    title, description, body = [], "", []
    headings: dict[str, list[str]] = {"h1": [], "h2": [], "h3": []}
    in_title, heading, words = False, None, []
    for (kind, name, attrs), seen in _visible(stream, _CONTENT_SKIP):
        if kind == TEXT:
            if seen and in_title:
                title.append(name)
            elif seen:
                body.append(name)
                if heading:
                    words.append(name)
        elif name == "title":
            in_title = kind == START
        elif name in headings:
            if kind == START:
                heading, words = name, []
            elif heading == name:
                if text := _flat(words):
                    headings[name].append(text)
                heading, words = None, []
        elif kind == START and name == "meta" and not description:
            if "description" == (attrs.get("name") or "").lower() or "og:description" == (attrs.get("property") or "").lower():
                description = (attrs.get("content") or "").strip()
    text = _flat(body)
    return {"title": _flat(title, ""), "description": description, **headings, "text": text, "words": len(_LETTERS.findall(text))}


def audit_view(stream: list[tuple]) -> dict:
    """Signals of a landing page."""
    out: dict = {"lang": None, "title": None, "description": None, "robots": None, "viewport": False, "canonical": None, "h1": [], "h2": [], "images": 0, "images_no_alt": 0, "ld_blocks": [], "clickable": []}
    holding, buffer, body, ld = None, [], [], None
    for (kind, name, attrs), seen in _visible(stream, _AUDIT_SKIP):
        if kind == TEXT:
            if ld is not None:
                ld.append(name)
                continue
            if seen and name.strip():
                body.append(name)
            if holding:
                buffer.append(name)
            continue
        role = "cta" if name in ("a", "button") else name if name in ("title", "h1", "h2") else None
        if kind == START:
            _note_start(out, name, attrs)
            if name == "script" and (attrs.get("type") or "").lower() == "application/ld+json":
                ld = []
            if role and not holding:  # elements inside a held one are part of it
                holding, buffer = role, []
        else:
            if name == "script" and ld is not None:
                if block := "".join(ld).strip():
                    out["ld_blocks"].append(block)
                ld = None
            if role and role == holding:
                if text := _flat(buffer, ""):
                    if role == "title":
                        out["title"] = out["title"] or text
                    else:
                        out["clickable" if role == "cta" else role].append(text)
                holding, buffer = None, []
    out["words"] = len(_AUDIT_WORD.findall(_flat(body)))
    out["ld_types"] = sorted({t for block in out["ld_blocks"] for t in ld_types(block)})
    hits = [(text, word) for text in out.pop("clickable") if len(text) <= 60 for word in [next((w for w, p in _CTA if p.search(text)), None)] if word]
    unique = {text.lower(): text for text, _ in reversed(hits)}
    out["ctas"] = len(hits)
    out["cta_words"] = sorted({w for _, w in hits})
    out["cta_samples"] = [unique[k] for k in dict.fromkeys(t.lower() for t, _ in hits)]
    return out


def _note_start(out: dict, name: str, attrs: dict) -> None:
    if name == "html" and out["lang"] is None:
        out["lang"] = attrs.get("lang")
    elif name == "img":
        out["images"] += 1
        out["images_no_alt"] += not (attrs.get("alt") or "").strip()
    elif name == "link" and out["canonical"] is None and "canonical" in (attrs.get("rel") or "").lower():
        out["canonical"] = attrs.get("href")
    elif name == "meta":
        what, value = (attrs.get("name") or "").lower(), attrs.get("content")
        if what == "viewport":
            out["viewport"] = True
        elif what in ("description", "robots") and value and out[what] is None:
            out[what] = value.strip()


def text_view(stream: list[tuple]) -> str:
    """Visible text with a line per block."""
    parts = []
    for (kind, name, _), seen in _visible(stream, _TEXT_SKIP, reset="body"):
        if kind == TEXT:
            parts.append(name if seen else "")
        elif name in _BLOCKS:
            parts.append("\n")
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(parts).splitlines())
    return "\n".join(x for x in lines if x)


def link_view(stream: list[tuple]) -> list[str]:
    return [attrs["href"] for kind, name, attrs in stream if kind == START and name == "a" and attrs.get("href")]


def ld_blocks(stream: list[tuple]) -> list[str]:
    """Non-blank JSON-LD scripts, the type compared without case and white space."""
    out, held = [], None
    for kind, name, attrs in stream:
        if kind == START and name == "script" and (attrs.get("type") or "").strip().lower() == "application/ld+json":
            held = []
        elif kind == TEXT and held is not None:
            held.append(name)
        elif kind == END and name == "script" and held is not None:
            if block := "".join(held).strip():
                out.append(block)
            held = None
    return out


def ld_nodes(value) -> Iterator[dict]:
    """All objects of a JSON value in document order, parents first; works through a list of its own, so depth is no limit."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            yield node
            todo += [v for v in reversed(list(node.values())) if isinstance(v, (dict, list))]
        elif isinstance(node, list):
            todo += reversed(node)


def node_types(node: dict) -> list[str]:
    t = node.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


_TYPE_SEEN = re.compile(r"""["']@type["'] *[:=]\s*["']([^"']+)["']""")


def ld_types(block: str) -> list[str]:
    """Types in a block; in a malformed one those that a pattern finds."""
    try:
        return [t for node in ld_nodes(json.loads(block)) for t in node_types(node)]
    except (ValueError, RecursionError):
        return _TYPE_SEEN.findall(block)


def _filled(node: dict, field: str) -> bool:
    value = node.get(field)
    return bool(value) if isinstance(value, (str, list, dict)) else value is not None


# Fields that a product's structured data should have, and identifiers of which one is enough.
REQUIRED = ("name", "image", "offers")
RECOMMENDED = ("description", "brand")
IDENTIFIERS = ("sku", "mpn", "gtin", "gtin8", "gtin12", "gtin13", "gtin14")


# The known states of availability, without their prefix.
AVAILABILITY = ("instock", "outofstock", "preorder", "backorder", "discontinued", "instoreonly", "limitedavailability", "onlineonly", "soldout")


def product_view(blocks: list[str]) -> dict:
    """Errors of the blocks, their distinct types, and which fields the first product lacks."""
    errors, types, product = [], {}, None
    for i, block in enumerate(blocks):
        try:
            nodes = list(ld_nodes(json.loads(block)))
        except (ValueError, RecursionError) as e:
            errors.append(f"{i}: {e}")
            continue
        for node in nodes:
            types.update(dict.fromkeys(node_types(node)))
            if product is None and any(t.lower() == "product" for t in node_types(node)):
                product = node
    if product is None:
        return {"errors": errors, "types": list(types), "found": False, "missing": list(REQUIRED), "advised": [*RECOMMENDED, "identifier"], "unknown_availability": None}
    missing, unknown = [f for f in REQUIRED[:2] if not _filled(product, f)], None
    offers = product.get("offers")
    offer = offers if isinstance(offers, dict) else next((o for o in offers if isinstance(o, dict)), None) if isinstance(offers, list) else None
    if offer is None:
        missing.append("offers")
    else:
        raw = offer.get("@type", "")
        ranged = any("AggregateOffer" in str(t) for t in (raw if isinstance(raw, list) else [raw]))
        if ranged and not (_filled(offer, "lowPrice") or _filled(offer, "highPrice")):
            missing.append("offers.lowPrice")
        wanted = ("priceCurrency",) if ranged else ("price", "priceCurrency", "availability")
        missing += [f"offers.{f}" for f in wanted if not _filled(offer, f)]
        state = offer.get("availability")
        if not ranged and _filled(offer, "availability") and str(state).strip().rsplit("/", 1)[-1].strip().lower() not in AVAILABILITY:
            unknown = str(state)
    advised = [f for f in RECOMMENDED if not _filled(product, f)] + ([] if any(_filled(product, f) for f in IDENTIFIERS) else ["sku/mpn/gtin"])
    return {"errors": errors, "types": list(types), "found": True, "missing": missing, "advised": advised, "unknown_availability": unknown}


def known_availability(value: Column) -> Column:
    """Whether a state of availability, given by name or url, is known."""
    return F.coalesce(F.lower(F.trim(F.element_at(F.split(value, "/"), -1))).isin(*AVAILABILITY), F.lit(False))


VIEWS = {
    "content": "struct<title:string,description:string,h1:array<string>,h2:array<string>,h3:array<string>,text:string,words:int>",
    "audit": "struct<lang:string,title:string,description:string,robots:string,viewport:boolean,canonical:string,h1:array<string>,h2:array<string>,images:int,images_no_alt:int,ld_blocks:array<string>,words:int,ld_types:array<string>,ctas:int,cta_words:array<string>,cta_samples:array<string>>",
    "text": "string",
    "links": "array<string>",
    "product": "struct<errors:array<string>,types:array<string>,found:boolean,missing:array<string>,advised:array<string>,unknown_availability:string>",
}


def _view(name: str, stream: list[tuple], sure: int):
    if name == "content":
        return content_view(stream[:sure])  # what an unfinished construct holds is not content
    if name == "audit":
        return audit_view(stream)
    if name == "text":
        return text_view(stream)
    if name == "links":
        return link_view(stream[:sure])
    return product_view(ld_blocks(stream[:sure]))


def parsed(pages: DataFrame, views: tuple[str, ...] = ("content",), key: str = "page_id") -> DataFrame:
    """(key, ok, error, one column per view) of ``pages`` (key, html). All views come from one tokenisation in one Python step."""
    key_type = dict(pages.dtypes)[key]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: dict[str, list] = {key: part[key].tolist(), "ok": [], "error": [], **{v: [] for v in views}}
            for html in part["html"]:
                values, error = dict.fromkeys(views), None
                if html is None:
                    error = "no html"
                else:
                    try:
                        stream, sure = tokens(html)
                        values = {v: _view(v, stream, sure) for v in views}
                    except Exception as e:  # a page that can't be read is a row with an error
                        error = f"{type(e).__name__}: {e}"
                out["ok"].append(error is None)
                out["error"].append(error)
                for v in views:
                    out[v].append(values[v])
            # A data frame of dictionaries is how nested columns travel.
            yield pd.DataFrame({k: pd.Series(v, dtype=object) if k not in (key, "ok") else v for k, v in out.items()})

    schema = f"{key} {key_type}, ok boolean, error string, " + ", ".join(f"{v} {VIEWS[v]}" for v in views)
    return pages.select(key, "html").mapInPandas(read, schema)


def signals(pages: DataFrame) -> DataFrame:
    """Audit signals of ``pages`` (page_id, final_url, html) with ``flags``, the findings in a fixed order."""
    read = parsed(pages, ("audit",))
    sides = pages.select("page_id", F.coalesce(F.col("final_url").startswith("https://"), F.lit(False)).alias("https"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    rows = read.join(sides, "page_id")
    a = F.col("audit")
    title, description, h1 = F.length(F.coalesce(a["title"], F.lit(""))), F.length(F.coalesce(a["description"], F.lit(""))), F.size(a["h1"])
    # The texts of the flags and their limits.
    rules: list[Column] = [
        F.when(~F.col("https"), "not HTTPS"),
        F.when(title == 0, "missing title").when(title > 60, "title too long (>60)"),
        F.when(description == 0, "no meta description").when(description < 50, "meta description too short").when(description > 160, "meta description too long (>160)"),
        F.when(h1 == 0, "missing H1").when(h1 > 1, "multiple H1"),
        F.when(~a["viewport"], "no viewport (not mobile-friendly)"),
        F.when(F.coalesce(a["lang"], F.lit("")) == "", "no html lang attribute"),
        F.when(F.size(a["ld_blocks"]) == 0, "no structured data"),
        F.when(a["words"] < 200, "thin content (<200 words)"),
        F.when((a["images"] > 0) & (a["images_no_alt"] > 0), F.concat(F.lit("images without alt ("), a["images_no_alt"], F.lit("/"), a["images"], F.lit(")"))),
        F.when(a["ctas"] == 0, "no clear call-to-action detected"),
        F.when(F.lower(F.coalesce(a["robots"], F.lit(""))).contains("noindex"), "page is noindex"),
    ]
    flags = F.when(F.col("ok"), F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return rows.select("page_id", "ok", "error", "https", "bytes", title.alias("title_length"), description.alias("description_length"), "audit", flags.alias("flags"))


def _folded(content: DataFrame, key: str) -> DataFrame:
    c = F.col("content")
    return content.filter("ok").select(key, fold_content(c["text"]).alias("body"), fold_content(c["title"]).alias("title"), fold_content(F.array_join(F.concat(c["h1"], c["h2"], c["h3"]), " \n ")).alias("heads"))


def _counted(rows: DataFrame, key: str) -> DataFrame:
    phrase = fold_content(F.col("keyword"))
    return rows.select(key, "keyword", phrase_count(phrase, F.col("body")).alias("count"), (phrase_count(phrase, F.col("title")) > 0).alias("in_title"), (phrase_count(phrase, F.col("heads")) > 0).alias("in_headings"))


def coverage(content: DataFrame, phrases: list[str], key: str = "page_id") -> DataFrame:
    """(key, keyword, count, in_title, in_headings) for every read page and each of a list of phrases; matching ignores case and marks.

    The full matrix has pages times phrases rows; for a table of phrases see ``phrase_matches``.
    """
    # The phrases are part of the plan, in blocks: a page row is expanded in place, nothing is joined.
    folded, out = _folded(content, key), None
    for a in range(0, max(1, len(phrases)), 1000):
        block = F.array(*[F.lit(p) for p in phrases[a : a + 1000]]).cast("array<string>")
        one = _counted(folded.withColumn("keyword", F.explode(block)), key)
        out = one if out is None else out.unionByName(one)
    return out


def phrase_matches(content: DataFrame, phrases: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, keyword, count, in_title, in_headings) of the pairs of a page and a phrase of ``phrases`` (keyword) that meet anywhere.

    All other cells of the matrix are 0 and need no rows. A page's word sequences, as long as the phrases are, are joined with
    those of the phrases; only pairs that share one are counted. Null phrases and those without a word match nothing.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), 0)
    wanted = written(phrases.filter("keyword IS NOT NULL").select("keyword").distinct().withColumn("w", words(fold_content(F.col("keyword")))).filter(F.size("w") > 0))
    lengths = sorted(r[0] for r in wanted.select(F.size("w")).distinct().collect())  # the lengths that occur, not the phrases
    folded = written(_folded(content, key))
    parts = folded.select(key, F.explode(F.array("body", "title", "heads")).alias("t")).select(key, words(F.col("t")).alias("w"))
    grams = None
    for n in lengths:
        starts = F.sequence(F.lit(1), F.size("w") - n + 1)
        one = parts.filter(F.size("w") >= n).select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n))))).alias("gram"))
        grams = one if grams is None else grams.unionByName(one)
    if grams is None:
        return _counted(folded.withColumn("keyword", F.lit(None).cast("string")).limit(0), key)
    pairs = grams.join(wanted.select("keyword", F.xxhash64("w").alias("gram")), "gram").select(key, "keyword").distinct()
    return _counted(folded.join(pairs, key), key).filter((F.col("count") > 0) | F.col("in_title") | F.col("in_headings"))


def missing_pages(content: DataFrame, phrases: DataFrame, key: str = "page_id") -> DataFrame:
    """(keyword, pages): on how many of the read pages each phrase's text count is 0, without the rows of the matrix."""
    hits = phrase_matches(content, phrases, key).filter("count > 0").groupBy("keyword").agg(F.count("*").alias("held"))
    read = content.agg(F.count_if("ok").alias("read"))
    # One row by construction of a global aggregate.
    rows = phrases.filter("keyword IS NOT NULL").select("keyword").distinct().join(hits, "keyword", "left").crossJoin(F.broadcast(read))
    return rows.select("keyword", (F.col("read") - F.coalesce("held", F.lit(0))).alias("pages")).filter("pages > 0")


def gaps(matrix: DataFrame, key: str = "page_id") -> DataFrame:
    return matrix.filter(F.col("count") == 0).select(key, "keyword")


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute url of a link without its fragment; null where it is no web address."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            url = urldefrag(urljoin(b, h.strip())).url
        except ValueError:
            return None
        return url if url.startswith(("http://", "https://")) else None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)

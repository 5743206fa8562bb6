"""Lines of markup as the reader sees them."""

from __future__ import annotations

import html as _html
import re

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(head|script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z)")
_NOSCRIPT = re.compile(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)")
_TAG = re.compile(r"(?s)<[/!?a-zA-Z][^<>]*>")


def _blank(m: re.Match) -> str:
    return "\n" * m.group().count("\n")


def _read(text: str) -> str:
    return (_html.unescape(text) if "&" in text else text).replace("\xa0", " ").strip()


def shown_text(line: str) -> str:
    return _read(_TAG.sub("", line))


def shown_lines(page: str) -> list[str]:
    """For each line of ``page`` (split at newline characters) the text it shows, '' for none."""
    page = _HIDDEN.sub(_blank, page)
    shown = _TAG.sub("", page)
    if shown.count("\n") != page.count("\n"):  # a tag goes over several lines
        shown = _TAG.sub(_blank, page)
    if "&" in shown:
        return [_read(x) for x in shown.split("\n")]
    return [x.strip() for x in shown.replace("\xa0", " ").split("\n")]


def notice_lines(page: str) -> list[str]:
    """Text for readers without scripts."""
    return [t for x in _NOSCRIPT.findall(page) if (t := shown_text(x))]

"""Words of texts: one normal form for all text operators."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_REFERENCE = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
#: Starts with the hyphen, so that a text is scanned once.
_BREAK = re.compile(r"[-‐‑­][ \t]*\r?\n\s*")
_LETTER = re.compile(r"[^\W_]")
#: Everything in ASCII but letters and digits becomes a blank.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def plain_text(text: str) -> str:
    """Text in lower case without markup, entities, reference numbers, soft hyphens and typographic variants."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _REFERENCE.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if "­" in text:
            text = re.sub("­(?:\\s*\\n\\s*)?", "", text)
        text = re.sub("[​-‍⁠﻿]", "", text)
    return text.lower()


def join_broken(text: str) -> str:
    """Joins words broken at a line end by a hyphen."""
    if "\n" not in text:
        return text
    parts, end = [], 0
    for m in _BREAK.finditer(text):
        if m.start() and _LETTER.match(text, m.start() - 1) and _LETTER.match(text, m.end()):
            parts.append(text[end : m.start()])
            end = m.end()
    return "".join([*parts, text[end:]]) if end else text


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the whole text in their order; [] for null."""
    if not text:
        return []
    plain = join_broken(plain_text(text))
    return plain.translate(_BLANKS).split() if plain.isascii() else _WORD.findall(plain)

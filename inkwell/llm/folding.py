"""One spelling for texts whose case, punctuation, spacing, markup or encoding differ."""

from __future__ import annotations

import html
import re
import unicodedata

#: UTF-8 bytes read as Windows-1252 (latin-1 where that has a gap), by rule for the letters of Latin-1 and common punctuation.
_MOJIBAKE: dict[str, str] = {}
for _c in [*map(chr, range(0xA0, 0x180)), *map(chr, range(0x2010, 0x2040)), "€", "™"]:
    for _wrong in ("cp1252", "latin-1"):
        try:
            _MOJIBAKE[_c.encode().decode(_wrong)] = _c
        except UnicodeDecodeError:
            _MOJIBAKE["".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in _c.encode())] = _c
_BROKEN = re.compile("|".join(map(re.escape, sorted(_MOJIBAKE, key=len, reverse=True))))
_MAY_BE_BROKEN = re.compile("[ÂÃÄÅâ]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ENTITY = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"\w+")


def repair(text: str) -> str:
    """``text`` without tags, entities, invisible characters and UTF-8 read in a wrong encoding, composed (NFKC)."""
    if text.isascii():
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
            return repair(text) if not text.isascii() else text
        return text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if _MAY_BE_BROKEN.search(text):
        text = _BROKEN.sub(lambda m: _MOJIBAKE[m[0]], text)
    text = _UNSEEN.sub("", text)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def folded_words(text: str) -> list[str]:
    """Words without case and punctuation; umlauts as two letters, whichever way they were written."""
    low = repair(text).casefold()
    if not low.isascii():
        low = low.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return _WORD.findall(low)

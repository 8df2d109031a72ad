"""Tables of characters that look like others, shared by the operators on characters and words.

``fold`` brings a text to the characters it looks like; it is the table of last resort of
problem 3 and the common ground on which the other operators compare words.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin letters (a subset of the
# public confusables data of Unicode TS 39, in the order of their code points).
CYRILLIC = dict(zip("ЅІЈАВЕКМНОРСТУХаеорсухѕіјһԁԛԝӏ", "SIJABEKMHOPCTYXaeopcyxsijhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορ", "ABEZHIKMNOPTYXvop", strict=True))
OTHER_LATIN = dict(zip("ıɑɡ", "iag", strict=True))
TO_LATIN = CYRILLIC | GREEK | OTHER_LATIN
# The letters by which Persian and Arabic spell the same shapes.
TO_ARABIC = {"ی": "ي", "ک": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه", "ے": "ي"}
TO_PERSIAN = {"ي": "ی", "ك": "ک", "ى": "ی"}
# Characters that show nothing, and the tashkeel and kashida that spelling may leave out.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏  ‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"
TASHKEEL = "ًٌٍَُِّْٰـ"
# Spaces and hyphens other than the plain ones.
SPACES = "               　"
HYPHENS = "‐‑⁃﹣－"
# Compatibility characters that a text may use on purpose.
KEEP = set("²³¹⁰⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ₀₁₂₃₄₅₆₇₈₉…ªº½¼¾¨´¸¯˚™℃℉№√−×÷·")

_STRAIGHT = {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS} | {ord(c): None for c in IGNORABLE}
#: Anything here and beyond makes a text worth folding; the rest is plain.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ÿŒœŠšŸ–—‘-‟•…€،؛؟ء-غف-ْ٠-٩پچژکگی۰-۹٪٫٬²³√≈−×÷ΔΩαβγλπ]*")


def wide(ch: str) -> str:
    """One character by its compatibility form, unless texts use it on purpose."""
    return ch if ch in KEEP else unicodedata.normalize("NFKC", ch)


_one: dict[str, str] = {}


def plain_forms(text: str) -> str:
    """Full-width, presentation, ligature and unit forms, spaces, hyphens and invisible characters; then composed.

    A zero-width non-joiner stays between Persian or Arabic letters.
    """
    if PLAIN.fullmatch(text):
        return text
    out = []
    for i, ch in enumerate(text):
        if ch <= "\x7e":
            out.append(ch)
            continue
        if ch == "‌" and 0 < i < len(text) - 1 and "ء" <= text[i - 1] <= "ۓ" and "ء" <= text[i + 1] <= "ۓ":
            out.append(ch)
            continue
        got = _one.get(ch)
        if got is None:
            got = _one[ch] = ch.translate(_STRAIGHT) if ord(ch) in _STRAIGHT else wide(ch)
        out.append(got)
    return unicodedata.normalize("NFC", "".join(out))


_LATIN = {ord(a): b for a, b in TO_LATIN.items()}
_MIXED = re.compile(r"[A-Za-zÀ-ÿЀ-ԯΑ-ωıɑɡ]+")


def latin_words(text: str) -> str:
    """Letters of other scripts by the Latin ones they look like, in words that have a Latin letter or are wholly look-alikes of a Cyrillic kind."""

    def one(m: re.Match) -> str:
        w = m[0]
        if w.isascii():
            return w
        t = w.translate(_LATIN)
        if t == w:
            return w
        latin = any("A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ" for c in w)
        return t if latin or all("A" <= c <= "Z" or "a" <= c <= "z" for c in t) and len(w) > 1 else w

    return _MIXED.sub(one, text)


def fold(text: str) -> str:
    """The text in the characters it looks like (Latin look-alikes included, Persian and Arabic letters left)."""
    if PLAIN.fullmatch(text):
        return text
    return latin_words(plain_forms(text))


_BARE = {ord(c): None for c in TASHKEEL + IGNORABLE}


def bare(text: str) -> str:
    """Folded, lower case, without tashkeel, kashida and joiners: what words are compared by."""
    return fold(text).translate(_BARE).lower()

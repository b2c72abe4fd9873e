"""Character classes and pre-token patterns for the standard ``re`` engine.

``re`` has no Unicode property classes; they are built once per process from the
character database, which makes its matching several times faster than an engine
that looks properties up as it goes.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: The Unicode White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def char_class(first: str, below: int = sys.maxunicode + 1) -> str:
    """Ranges, for use inside [], of the characters under ``below`` whose category starts with ``first``."""
    out, start = [], None
    for c in range(below + 1):
        yes = c < below and unicodedata.category(chr(c))[0] == first
        if yes and start is None:
            start = c
        elif not yes and start is not None:
            out.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def letters_first(pattern: str) -> str:
    """The same pattern with alternatives that start at a letter or number ahead of those that start at an apostrophe.

    No text position suits both kinds, so the order between them doesn't matter, and
    most pre-tokens are then found by the first alternative tried.
    """
    parts = re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^|])+", pattern)
    early = [p for p in parts if re.fullmatch(r" ?\[?\\p\{[LN]\}\]?\+?", p)]
    lead = len(parts) and next((i for i, p in enumerate(parts) if p[0] != "'"), len(parts))
    if not early or parts[lead : lead + len(early)] != early:
        return pattern
    return "|".join([*early, *parts[:lead], *parts[lead + len(early) :]])


@functools.cache
def translated(pattern: str, below: int = sys.maxunicode + 1) -> re.Pattern:
    r"""``pattern`` with \p{L}, \p{N}, \s and \S, as a pattern of ``re`` for texts of characters under ``below``."""
    letters, numbers = char_class("L", below), char_class("N", below)
    white = "".join(c for c in WHITE_SPACE if ord(c) < below)
    out, inside, i, pattern = [], False, 0, letters_first(pattern)
    while i < len(pattern):
        if pattern.startswith((r"\p{L}", r"\p{N}"), i):
            ranges = letters if pattern[i + 3] == "L" else numbers
            out.append(ranges if inside else f"[{ranges}]")
            i += 5
        elif pattern.startswith(r"\s", i):
            out.append(white if inside else f"[{white}]")
            i += 2
        elif pattern.startswith(r"\S", i) and not inside:
            out.append(f"[^{white}]")
            i += 2
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


def splitter(pattern: str):
    """A function from a text to its list of matches; texts of characters under 256 take the smaller classes."""
    every, latin = translated(pattern).findall, translated(pattern, 256).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return split

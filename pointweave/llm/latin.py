"""Patterns of letters, numbers and white space for texts of characters below U+0250, which ``re`` matches faster."""

from __future__ import annotations

import re

import regex

#: The first character that the plain classes don't cover.
END = 0x250
#: Finds a character that they don't cover.
BEYOND = re.compile(f"[^\x00-{chr(END - 1)}]").search


def plain_pattern(pattern: str) -> str | None:
    """The same pattern with plain classes, or None if it has other escapes than ``\\p{L} \\p{N} \\s \\S``."""
    held = {}
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        found = regex.compile(name).fullmatch
        held[name] = "".join(re.escape(chr(c)) for c in range(END) if found(chr(c)))
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in held if pattern.startswith(n, at)), None)
        if name is None and pattern[at] == "\\":
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at] if name is None else held[name] if inside else f"[{held[name]}]")
        at += len(name or " ")
    return "".join(out)

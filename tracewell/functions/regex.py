"""Patterns of the RE2 dialect for Java's regular expressions."""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
_BOUND = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: What follows a bound, or stands before it, where one side is a word character for certain.
_BEGINS = re.compile(r"\\b(?=(?:\((?:\?:)?)*(?:[A-Za-z0-9_]|\\d|\[(?:A-Z|a-z|0-9|_)+\](?![*?])))")
_ENDS = re.compile(r"((?:\[(?:A-Z|a-z|A-F|a-f|0-9|_)+\]|\\d)(?:\+|\{\d+,?\d*\}))\\b")


def re2_space(pattern: str, end: str = "$") -> str:
    r"""The pattern with \s as RE2 has it, inside and outside of classes: no U+000B; end stands for an end of text."""
    inside = False

    def put(m: re.Match) -> str:
        nonlocal inside
        if m[0] == "$":
            return m[0] if inside else end
        if m[0] == "[":
            inside = True
        elif m[0] == "]":
            inside = False
        elif m[1] == "s":
            return r"\t\n\f\r " if inside else r"[\t\n\f\r ]"
        elif m[1] == "S":
            return r"[^\t\n\f\r ]"
        return m[0]

    return re.sub(r"\\(.)|\[|\]|\$", put, pattern)


def re2(pattern: str) -> str:
    r"""The pattern with word bounds of ASCII letters and white space without U+000B, as RE2 has them.

    Java's \b knows all letters, its \s, like Python's, takes the vertical tab, its lines end with other characters
    than line feeds too, and its $ also stands before a last line end.

    Where one side of a bound is certain, only the other is looked at, which is faster.  A group's
    first alternative tells for all: patterns here don't mix words with other beginnings.
    """
    out = re2_space(pattern, "$" if re.match(r"\(\?[a-z]*m", pattern) else r"\z")
    out = _ENDS.sub(rf"\1(?!{_WORD})", out)
    out = _BEGINS.sub(rf"(?<!{_WORD})", out)
    return "(?d)" + out.replace(r"\b", _BOUND)

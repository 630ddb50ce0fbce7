"""Cutting texts for byte-level BPE: pieces of a pattern, and chunks at single blanks that hold whole pieces.

A blank between two characters that are no white space always begins a piece, and no piece reaches over it. A text can
so be cut before such blanks, and equal chunks are cut into equal pieces wherever they stand.
"""

from __future__ import annotations

import regex

#: White space as the tokenizer libraries understand \s (regex's own also holds some control characters).
_SPACE = r"\p{White_Space}"
_RARE = regex.compile(r"[\x85\xa0  -     　]")
_SAFE = regex.compile(rf"(?<=\P{{White_Space}}) (?=\P{{White_Space}})")
_EDGES = ("  ", *(x for c in "\t\n\v\f\r" for x in (f" {c}", f"{c} ")))


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", _SPACE))


def chunks(text: str) -> list[str]:
    """The text cut at blanks between two non-space characters; a blank was in front of each chunk but the first."""
    if text[:1] != " " and text[-1:] != " " and not any(e in text for e in _EDGES) and (text.isascii() or not _RARE.search(text)):
        return text.split(" ")
    return _SAFE.split(text)

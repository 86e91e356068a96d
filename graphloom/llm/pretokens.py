"""Cutting texts where no pre-token of the byte-level pattern can cross, so that counts and ids can be kept by word.

The pattern puts a space only at a pre-token's start or in a run of white space. So a space after a character other than
white space always starts a pre-token, and what lies between two such spaces is split alike inside and outside its text.
"""

from __future__ import annotations

import re

_BEFORE = re.compile(r"(?:\A|\s) ")
_START = re.compile(r"(?<=\S) ")


def chunks(text: str) -> list[str]:
    """Parts that give the text when joined by single spaces; every part but the first stands after a space of its own."""
    return _START.split(text) if _BEFORE.search(text) else text.split(" ")

"""Compiled patterns by their text: the regex module's own cache is looked up far more slowly."""

from __future__ import annotations

from functools import lru_cache

import regex


@lru_cache(None)
def rx(pattern: str, flags: int = 0) -> regex.Pattern:
    """The compiled pattern; only patterns written in code are passed, so their number is bounded."""
    return regex.compile(pattern, flags)

"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control characters removed from text cells (U+0000-U+001F,
# U+007F-U+009F), and the characters kept in folder names (Unicode word
# characters, '-', '_', '.', blank).
CONTROL_SET = "".join(chr(c) for c in list(range(0x00, 0x20)) + list(range(0x7F, 0xA0)))
FOLDER_UNSAFE = r"(?U)[^\w\-_. ]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(x) -> Column:
    """Remove control characters: ``translate`` deletes every character of
    the set through a character map (no regex per cell)."""
    return F.translate(_c(x), CONTROL_SET, "")


def sanitize_folder_name(x) -> Column:
    return F.regexp_replace(_c(x), FOLDER_UNSAFE, "_")

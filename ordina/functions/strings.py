"""Text as SQL engines other than Spark give it: upper case of one character for each, Base64 in one line."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose whole upper case is several characters (ß, ligatures, Greek with marks), and their single one: mostly themselves.
_WIDE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1)
_SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE)


def upper(c: Column) -> Column:
    """Upper case that keeps a text's length. `F.upper` makes SS of ß."""
    parts = F.regexp_extract_all(c, F.lit(f"[{_WIDE}]|[^{_WIDE}]+"), F.lit(0))
    by_part = F.transform(parts, lambda p: F.when(F.contains(F.lit(_WIDE), p), F.translate(p, _WIDE, _SINGLE)).otherwise(F.upper(p)))
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.array_join(by_part, ""))


def base64(c: Column) -> Column:
    """Base64 in one line; `F.base64` may break it after each 76 characters."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))

"""Text functions as column expressions; all run inside the JVM.

Nulls stay null.  Offsets count code points.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers see it (Java's own class is ASCII only).
SPACE = r"[\s   -     　﻿]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def cleaned(c: Column) -> Column:
    """Line ends made LF, runs of blanks single, blanks before LF dropped, at most one empty line, ends trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    c = F.regexp_replace(c, r" +\n", "\n")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """(from, to) for ``translate``: letters that decompose to one base letter; combining marks have no target and go."""
    source, target, marks = [], [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF) + 1):
        ch = chr(code)
        if 0x300 <= code <= 0x36F:
            marks.append(ch)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source) + "đĐ" + "".join(marks), "".join(target) + "dD"


def folded(c: Column) -> Column:
    """Accents and case removed."""
    source, target = fold_table()
    return F.lower(F.translate(c, source, target))


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def snippet(c: Column, most: int = 160) -> Column:
    flat = trimmed(F.regexp_replace(c, f"{SPACE}+", " "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, most), f"{SPACE}+$", ""), F.lit("…"))
    return F.when(F.length(flat) <= most, flat).otherwise(cut)


def export_name(c: Column) -> Column:
    """A safe file name of at most 80 characters."""
    c = F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', " ")
    c = trimmed(F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "."), f"{SPACE}+", " "))
    c = trimmed(F.substring(c, 1, 80))
    return F.when(c == "", "studio").otherwise(c)


def normalized_url(c: Column) -> Column:
    """Scheme and host lower-cased, fragment and final slash dropped."""
    c = F.regexp_replace(trimmed(c), r"#.*$", "")
    head, rest = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    return F.concat(head, F.when((path != "/") & rest.endswith("/"), F.regexp_replace(rest, "/$", "")).otherwise(rest))

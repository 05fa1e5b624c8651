"""Tokens of text: runs of letters, digits and private-use characters, case and single diacritics folded."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PATTERN = r"[\p{L}\p{N}\p{Co}\p{M}]+"
_RUN = regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return str.maketrans(*folding())


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Letters of one base and one mark -> the base; letters of several marks stay as they are."""
    pairs = []
    for cp in range(0xC0, min(0x2000, sys.maxunicode)):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) == 2 and unicodedata.combining(d[1]) and c == c.lower() and unicodedata.category(c).startswith("L"):
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(x: Column) -> Column:
    a, b = folding()
    # ASCII has nothing to fold
    return let(F.lower(x), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, a, b)))


def tokens(x: Column | str) -> Column:
    """Tokens of a text in order, not stemmed; marks that stand alone inside a token go."""
    x = F.col(x) if isinstance(x, str) else x

    def found(text: Column) -> Column:
        plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
        bare = F.filter(F.transform(plain, lambda t: F.regexp_replace(t, r"\p{M}", "")), lambda t: t != "")
        # a text is asked once, not each of its tokens
        return F.when((F.octet_length(text) == F.length(text)) | ~text.rlike(r"\p{M}"), plain).otherwise(bare)

    return let(folded(F.coalesce(x, F.lit(""))), found)


def tokenize(text: str) -> list[str]:
    """The same for a query."""
    found = (regex.sub(r"\p{M}", "", t) for t in _RUN.findall(text.lower().translate(_table())))
    return [t for t in found if t]

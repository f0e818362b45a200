"""Column helpers for text: defaults, percent-encoding, trimming, tokens. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def filled(c: Column) -> Column:
    """A text, or NULL where it is NULL or empty. White space counts as content."""
    return F.nullif(c, F.lit(""))


def text_or(c: Column, default: str) -> Column:
    """A text, or the default where it is NULL or empty."""
    return F.coalesce(filled(c), F.lit(default))


def count_or(c: Column, default: str) -> Column:
    """A number as text, or the default where it is NULL or 0. Cast first: ANSI mode refuses mixed types."""
    return F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(default))


def encode_component(c: Column) -> Column:
    """Percent-encoding of one URL component in UTF-8; `A-Za-z0-9-_.!~*'()` stay as they are."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, line ends and byte-order marks included."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def grouped_number(c: Column) -> Column:
    """A whole number with comma-grouped thousands."""
    return F.format_number(c, 0)

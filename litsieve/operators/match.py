"""A local evaluator of the search predicates (how the remote service matches is not known): plain column predicates.

Terms are tokens, runs of letters and digits in lower case; a request's words are split the same way.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsieve.functions.text import filled, tokens


def has_all(text_tokens: Column, words: Column) -> Column:
    """Every word occurs. No words: true."""
    return F.size(F.array_except(tokens(words), text_tokens)) == 0


def has_phrase(text_tokens: Column, phrase: Column) -> Column:
    """The words occur next to each other in order. No words: true."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return (F.size(tokens(phrase)) == 0) | F.contains(spaced(text_tokens), spaced(tokens(phrase)))


def has_any(text_tokens: Column, words: Column) -> Column:
    """At least one word occurs. No words: true."""
    return (F.size(tokens(words)) == 0) | F.arrays_overlap(text_tokens, tokens(words))


def has_none(text_tokens: Column, words: Column) -> Column:
    """No word occurs."""
    return ~F.arrays_overlap(text_tokens, tokens(words))


def field_contains(field: Column, part: Column) -> Column:
    """The field holds the part, in any capitals. No part: true."""
    return filled(part).isNull() | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lower(part))


def year_bound(year: Column) -> Column:
    """A bound given as text, as a number; what isn't a number bounds nothing."""
    return filled(year).try_cast("int")


def year_within(year: Column, lo: Column, hi: Column) -> Column:
    """lo <= year <= hi, a null bound asks for nothing."""
    return (lo.isNull() | (year >= lo)) & (hi.isNull() | (year <= hi))


def year_between(year: Column, low: Column, high: Column) -> Column:
    """low <= year <= high, each bound optional (given as text; what isn't a number bounds nothing)."""
    return year_within(year, year_bound(low), year_bound(high))


def matches(request: dict[str, str], text: Column, title: Column, author: Column, source: Column, year: Column) -> Column:
    """The whole request against one row's columns; unset fields ask for nothing.

    Fields that need no tokens are tested first, and the tokens are made once: they are the argument of one lambda. A null text or
    title counts as empty.
    """
    get = lambda k: F.lit(request.get(k) or "")
    out = F.lit(True)
    if request.get("ylo") or request.get("yhi"):
        out = out & year_between(year, get("ylo"), get("yhi"))
    for key, field in (("author", author), ("source", source)):
        if request.get(key):
            out = out & field_contains(field, get(key))
    asked = [(key, ask) for key, ask in (("allWords", has_all), ("exact", has_phrase), ("atLeast", has_any), ("without", has_none)) if request.get(key)]
    if asked:
        where = tokens(F.coalesce(title if request.get("scope") == "title" else text, F.lit("")))
        out = out & F.exists(F.array(where), lambda t: reduce(and_, (ask(t, get(key)) for key, ask in asked)))
    return out

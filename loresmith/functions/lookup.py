"""Small literal tables as expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, mapping: Mapping, default) -> Column:
    """mapping[key], or ``default``; a chain of comparisons that stays inside generated code."""
    items = list(mapping.items())
    if not items:
        return F.lit(default)
    chain = F.when(key == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        chain = chain.when(key == k, F.lit(v))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def mentions_any(text: Column, words: Sequence[str]) -> Column:
    """True when any word occurs in the (already lower-cased) text; containment, not whole tokens."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words])


def matching_tags(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Ordered array of the dictionary's tags that occur in the (already lower-cased) text."""
    return F.array_compact(F.array(*[F.when(mentions_any(text, ws), F.lit(tag)) for tag, ws in dictionary.items()]))


def first_tag(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """First tag of the dictionary that occurs in the text, or null."""
    return F.coalesce(*[F.when(mentions_any(text, ws), F.lit(tag)) for tag, ws in dictionary.items()])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]

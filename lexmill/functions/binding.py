"""Name an intermediate column inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(phrases: list[str]) -> str:
    """Regex alternation of literal phrases."""
    return "(?:" + "|".join(rf"\Q{p}\E" for p in phrases) + ")"

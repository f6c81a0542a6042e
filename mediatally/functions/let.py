"""Naming a sub-expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, however often `use` mentions it.

    A column helper that mentions its input many times multiplies the whole input expression, and
    nested helpers multiply again; a lambda variable stops that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))

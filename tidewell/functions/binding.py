"""Binding a value to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A name bound by a projection may be inlined into each of its uses, inside
    a lambda even for each element; a lambda variable is never inlined.
    """
    return F.transform(F.array(value), body)[0]

"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    A column used inside a lambda is evaluated again for every element; as a
    lambda variable it is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

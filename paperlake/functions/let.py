"""Names for intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once a row; an expression that stands in a lambda is evaluated anew for each element and place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

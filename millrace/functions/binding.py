"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once per row however often ``body`` names it.

    A plain ``body(value)`` writes the whole expression of ``value`` in each place, so steps
    that build on one another grow with the product of their uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

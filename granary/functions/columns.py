"""Building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once (the planner would put its expression into every place, lambdas included)."""
    return F.transform(F.array(value), body)[0]

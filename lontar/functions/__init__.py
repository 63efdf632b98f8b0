"""Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it uses more than once, so that the value is worked out once for each row."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))

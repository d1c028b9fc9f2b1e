"""Array Column functions that stay near linear in the array's length.

A fold copies what it carries at every step, so it must not carry an array that
grows; running values are made from those of stretches of growing length instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stretches that a level of running values joins, and levels: enough for arrays of WIDE ** LEVELS elements (16 million); longer ones are an error.
WIDE, LEVELS = 64, 4


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Of each element of an array of numbers, it joined with all before it; join is associative, a sum or F.greatest."""

    def longer(level: int) -> Callable[[Column], Column]:
        # each element holds WIDE ** level elements that end with it
        def step(x: Column) -> Column:
            far = WIDE**level

            def joined(v: Column, i: Column) -> Column:
                back = F.sequence(F.lit(1), F.least(F.lit(WIDE - 1), F.floor(i / far).cast("int")))
                return F.when(i < far, v).otherwise(F.aggregate(back, v, lambda a, j: join(F.get(x, i - j * far), a)))

            more = F.transform(x, joined)
            last = F.when(F.size(x) <= far * WIDE, more).otherwise(F.raise_error(F.lit(f"running values of more than {far * WIDE} elements")))
            return F.when(F.size(x) <= far, x).otherwise(once(more, longer(level + 1)) if level + 1 < LEVELS else last)

        return step

    return once(values, longer(0))

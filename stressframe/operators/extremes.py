"""Extremes with their element, without sorting rows.

An extreme of (value, tie-break) as a struct makes Spark sort all rows of a task, as structs
do not fit the fixed slots of a hash aggregation. Here value and tie-break are one decimal of
126 bits, which does: the value as the whole number that its bits are when ordered, then 62
bits of the tie-break. The numbers are made by arithmetic that is exact for powers of two.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the tie-break; of these, of an element behind a state.
BITS, ELEMENT_BITS = 62, 40
_INFINITE = 2047 << 52
#: Columns up to which extremes are hashed. A decimal costs more than a share of a sort, so beyond them rows are sorted once for all.
HASHED = 2


def with_order_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` and, for each column of doubles, a long ``__k_<column>`` that orders as Spark does: -inf, numbers (-0 as 0), inf, NaN; NULL for NULL.

    In steps, each a projection, so that no step's expressions are worked out twice.
    """
    power, held = (lambda e: F.pow(F.lit(2.0), e)), [F.col(f"`{c}`") for c in df.columns]
    names = [c for c in dict.fromkeys(columns)]
    size = {c: F.abs(F.col(f"`{c}`")) for c in names}
    plain = {c: (size[c] > 0) & (size[c] < float("inf")) for c in names}
    df = df.select(*held, *(F.when(plain[c], F.greatest(F.least(F.floor(F.log2(size[c])).cast("int"), F.lit(1023)), F.lit(-1022))).alias(f"__g_{c}") for c in names))  # off by one at most, near powers of two
    df = df.select(*held, *(F.col(f"__g_{c}") for c in names), *((size[c] / power(F.col(f"__g_{c}"))).alias(f"__p_{c}") for c in names))

    def exponent(c: str) -> Column:
        g, part = F.col(f"__g_{c}"), F.col(f"__p_{c}")
        return g + F.when(part >= 2, 1).when((part < 1) & (g > -1022), -1).otherwise(0)

    def mantissa(c: str) -> Column:
        """The part moved by the same power of two, as a whole number of 53 bits."""
        g, part = F.col(f"__g_{c}"), F.col(f"__p_{c}")
        return (part * F.when(part >= 2, float(1 << 51)).when((part < 1) & (g > -1022), float(1 << 53)).otherwise(float(1 << 52))).cast("long")

    def key(c: str) -> Column:
        v = F.col(f"`{c}`")
        special = F.when(v == 0, F.lit(0).cast("long")).when(F.isnan(v), F.lit(_INFINITE + 1)).when(v.isNotNull(), F.lit(_INFINITE))
        bits = F.when(plain[c], (exponent(c).cast("long") + 1022) * F.lit(1 << 52) + mantissa(c)).otherwise(special)
        return (bits * F.when(v < 0, -1).otherwise(1)).alias(f"__k_{c}")

    return df.select(*held, *(key(c) for c in names))


def _number(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(19,0)")


def with_extremes(df: DataFrame, columns: Sequence[str], tie: Column) -> DataFrame:
    """``df`` and, for each column, ``__max_<column>`` and ``__min_<column>``, which are largest for the largest and for the least value, and of equal ones for the least ``tie`` (0 to 2^62 - 1)."""
    held = [F.col(f"`{c}`") for c in df.columns]
    if len(set(columns)) > HASHED:
        of = lambda c, v: F.when(F.col(f"`{c}`").isNotNull(), F.struct(v, -tie))
        return df.select(*held, *(x for c in dict.fromkeys(columns) for x in (of(c, F.col(f"`{c}`")).alias(f"__max_{c}"), of(c, -F.col(f"`{c}`")).alias(f"__min_{c}"))))
    whole = F.when((tie >= 0) & (tie < F.lit(1 << BITS)), tie).otherwise(F.raise_error(F.lit("an id is out of the range of tie-breaks")).cast("long"))
    keyed = with_order_keys(df.select(*held, (F.lit((1 << BITS) - 1) - whole).cast("decimal(19,0)").alias("__tie")), columns)
    name = lambda c, sign: "__max_" + c if sign > 0 else "__min_" + c
    return keyed.select(*held, *(((F.col(f"__k_{c}") * sign).cast("decimal(20,0)") * _number(1 << BITS) + F.col("__tie")).alias(name(c, sign)) for c in dict.fromkeys(columns) for sign in (1, -1)))


def tie_of(state: Column, element: Column) -> Column:
    """A tie-break by state, then by element."""
    small = (state >= 0) & (state < F.lit(1 << (BITS - ELEMENT_BITS))) & (element >= 0) & (element < F.lit(1 << ELEMENT_BITS))
    return F.when(small, state.cast("long") * F.lit(1 << ELEMENT_BITS) + element.cast("long")).otherwise(F.lit(-1).cast("long"))


def at_largest(what: str | Column, c: str) -> Column:
    """Aggregate over ``with_extremes``: ``what`` of the row with the largest value of a column."""
    return F.max_by(what, F.col(f"__max_{c}"))


def at_least(what: str | Column, c: str) -> Column:
    return F.max_by(what, F.col(f"__min_{c}"))

"""Encodings of series and grids: deltas, exclusive-or deltas and quantisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def delta(value: Column, w: WindowSpec) -> Column:
    """First value as it is, then differences."""
    return value - F.coalesce(F.lag(value).over(w), F.lit(0))


def undelta(value: Column, w: WindowSpec) -> Column:
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def wrap16(value: Column) -> Column:
    """A whole number wrapped to 16 signed bits."""
    return (F.pmod(value.cast("long") + 32768, F.lit(65536)) - 32768).cast("int")


def quantized_delta(value: Column, step: float, w: WindowSpec) -> Column:
    """Differences of multiples of ``step``, wrapped to 16 bits; ``undelta`` and ``wrap16`` bring them back."""
    return wrap16(delta(F.round(value / step).cast("long"), w))


def xor_delta(value: Column, w: WindowSpec) -> Column:
    return value.bitwiseXOR(F.coalesce(F.lag(value).over(w), F.lit(0).cast("long")))


def unxor(value: Column, w: WindowSpec) -> Column:
    return F.bit_xor(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bits_for(levels: int) -> int:
    """Bits that tell so many levels apart."""
    return max(1, (max(levels, 1) - 1).bit_length())


def linear(value: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """Nearest of 2^bits - 1 equal steps from low to high; half way where they are equal."""
    top = (1 << bits) - 1
    share = F.when(high > low, F.try_divide(value - low, high - low)).when(value.isNotNull(), 0.5)
    return F.round(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * top).cast("int")


def unlinear(code: Column, low: Column, high: Column, bits: int = 16) -> Column:
    return low + code / ((1 << bits) - 1) * (high - low)


def strain(value: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """As ``linear``; a range that is nothing for a strain (under 1e-15) is half way too."""
    return linear(value, low, F.when(high - low > 1e-15, high).otherwise(low), bits)


def logarithmic(value: Column, floor: float, high: Column, bits: int = 16) -> Column:
    """Equal steps of the logarithm from floor to high; what is not above the floor is 0."""
    v = F.greatest(value, F.lit(floor))
    return linear(F.ln(v), F.ln(F.lit(floor)), F.ln(F.greatest(high, F.lit(floor))), bits)


def unlogarithmic(code: Column, floor: float, high: Column, bits: int = 16) -> Column:
    return F.exp(unlinear(code, F.ln(F.lit(floor)), F.ln(F.greatest(high, F.lit(floor))), bits))


def quantize(df: DataFrame, columns: list[str], bits: int = 16) -> DataFrame:
    """Codes of each column over the range of all its rows, which goes along as one broadcast row."""
    ranges = df.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max))))
    out = df.crossJoin(F.broadcast(ranges))
    return out.withColumns({f"{c}_code": linear(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"), bits) for c in columns})

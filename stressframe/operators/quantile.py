"""Exact percentiles of all rows, without all rows in one task.

A histogram of the range tells in which bin a rank is; that bin becomes the range, until few
rows are left in it. A pass is one aggregation of at most BINS groups; only bin counts, and
at last up to FEW values, reach the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from math import floor
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize, release
from .extremes import with_order_keys

#: Parameters: bins of a histogram, and values of the last range at most.
BINS, FEW = 1024, 20_000


def order_statistics(df: DataFrame, c: str, shares: Sequence[float]) -> list[float | None]:
    """The percentile of ``c`` at each share (0 to 1), linear between neighbours; None without values. Runs jobs at once.

    NaN and NULL are no values. Infinite ones are counted apart, as they stand before and behind
    all others. A bin in which the range would not shrink, as where values of all sizes are
    mixed, is cut by the values' order of size instead of by their width.
    """
    rows = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    finite = rows.where(F.abs("v") < float("inf"))
    real = F.when(F.abs("v") < float("inf"), F.col("v"))
    below, above, m, low, high = rows.agg(F.count_if(F.col("v") == float("-inf")), F.count_if(F.col("v") == float("inf")), F.count(real), F.min(real), F.max(real)).first()
    n = below + m + above
    if not n:
        return [None] * len(shares)
    bins: dict[tuple, list] = {}
    values: dict[tuple, list[float]] = {}

    def at(rank: int) -> float:
        if rank < below:
            return float("-inf")
        if rank >= below + m:
            return float("inf")
        a, b, before, k = low, high, below, m
        while a < b and k > FEW:
            if (a, b) not in bins:
                bins[a, b] = _bins(finite, a, b)
            for size, start, end in bins[a, b]:
                if rank < before + size:
                    a, b, k = start, end, size
                    break
                before += size
        if a == b:
            return a
        if (a, b) not in values:
            values[a, b] = sorted(r["v"] for r in finite.where(F.col("v").between(a, b)).collect())
        return values[a, b][rank - before]

    out: list[float | None] = []
    for share in shares:
        place = share * (n - 1)
        i = floor(place)
        one = at(i)
        other = at(i + 1) if place > i else one
        out.append(one if other == one else one + (other - one) * (place - i))
    return out


def _bins(rows: DataFrame, low: float, high: float) -> list[tuple[int, float, float]]:
    """(rows, least, largest) of each bin between two values, in order, by equal widths; if one bin keeps all but a few rows, by equal steps of the order of doubles."""
    span = rows.where(F.col("v").between(low, high))
    # halves, as the difference of two doubles may be infinite
    place = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * BINS), F.lit(BINS - 1))
    found = _counts(span, place)
    total = sum(r[0] for r in found)
    if max(r[0] for r in found) <= total * 0.9:
        return found
    keyed = with_order_keys(span, ["v"])
    first, last = _key(low), _key(high)
    step = max(1, -(-(last - first) // BINS))
    return _counts(keyed, F.floor((F.col("__k_v").cast("decimal(20,0)") - F.lit(Decimal(first))) / F.lit(Decimal(step))))


def _counts(span: DataFrame, place: Column) -> list[tuple[int, float, float]]:
    return [tuple(r)[1:] for r in sorted(span.groupBy(place.cast("long").alias("b")).agg(F.count("*"), F.min("v"), F.max("v")).collect())]


def _key(v: float) -> int:
    """The place of a double in the order of all."""
    bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -bits if v < 0 else bits


#: Bits of a value's place in order that are told apart before each round of ``group_order_statistics``.
SHIFTS = (64, 54, 44, 34, 24, 14, 0)


def group_order_statistics(df: DataFrame, by: Sequence[str], c: str, shares: Sequence[float | None], few: int = FEW) -> DataFrame:
    """``by``, n and q0, q1, ...: the percentiles of ``c`` of all groups together, linear between neighbours; a share of None is the middle value, the upper of two. Runs jobs at once.

    Ranks are narrowed down by the leading bits of values in their order, ten a round: rows
    that share the bits found so far with a wanted rank of their group are counted by the next
    ones, in tasks first. A rank leaves the rounds when ``few`` rows are left beside it, and
    is found among these; so no group is held or sorted as a whole, however large. NaN and
    NULL are no values; infinite ones are.
    """
    by = list(by)
    value = F.col(c).cast("double")
    rows = materialize(with_order_keys(df.select(*by, value.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")), ["__v"]).withColumnRenamed("__k___v", "__k"))
    counts = materialize(rows.groupBy(*by).agg(F.count("*").alias("n")))
    place = F.when(F.col("share").isNull(), F.floor(F.col("n") / 2)).otherwise(F.col("share") * (F.col("n") - 1))
    wanted = counts.select(*by, "n", F.posexplode(F.array(*(F.lit(None if x is None else float(x)).cast("double") for x in shares))).alias("i", "share")).select(*by, "n", "i", place.alias("place"))
    ranks = wanted.select(*by, "n", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).distinct()
    open_ = materialize(ranks.select(*by, "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.col("n").alias("size")))
    same = lambda a, b, more=(): reduce(and_, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in by] + list(more))
    prefix = lambda shift: F.lit(0).cast("long") if shift == 64 else F.shiftright(F.col("__k"), shift)
    found, tables = [], [rows, counts, open_]
    for k, shift in enumerate(SHIFTS):
        last = k == len(SHIFTS) - 1
        near = open_ if last else open_.where(F.col("size") <= few)
        inside = rows.withColumn("prefix", prefix(shift)).alias("r").join(near.select(*by, "prefix").distinct().alias("o"), same("r", "o", [F.col("r.prefix") == F.col("o.prefix")]), "left_semi")
        if last:  # all rows of a prefix are one value
            held = inside.groupBy(*by, "prefix").agg(F.min("__v").alias("value")).alias("h")
            found.append(near.alias("o").join(held, same("o", "h", [F.col("o.prefix") == F.col("h.prefix")])).select(*(F.col(f"o.{g}") for g in by), F.col("o.rank"), F.col("h.value")))
            break
        order = F.row_number().over(Window.partitionBy(*by, "prefix").orderBy("__k")) - 1  # few rows each
        held = inside.select(*by, "prefix", F.col("__v").alias("value"), order.alias("at")).alias("h")
        found.append(near.alias("o").join(held, same("o", "h", [F.col("o.prefix") == F.col("h.prefix"), F.col("o.rank") - F.col("o.before") == F.col("h.at")])).select(*(F.col(f"o.{g}") for g in by), F.col("o.rank"), F.col("h.value")))
        rest = open_.where(F.col("size") > few)
        if not rest.take(1):
            break
        ranges = rest.select(*by, "prefix").distinct().alias("o")
        parts = rows.withColumn("prefix", prefix(shift)).alias("r").join(ranges, same("r", "o", [F.col("r.prefix") == F.col("o.prefix")]), "left_semi").groupBy(*by, "prefix", F.shiftright(F.col("__k"), SHIFTS[k + 1]).alias("next")).agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*by, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, -1))  # a row for each of the next bits
        bins = parts.withColumn("upto", F.coalesce(upto, F.lit(0))).alias("b")
        rank = F.col("o.rank") - F.col("o.before")
        met = rest.alias("o").join(bins, same("o", "b", [F.col("o.prefix") == F.col("b.prefix"), rank >= F.col("b.upto"), rank < F.col("b.upto") + F.col("b.m")]))
        open_ = materialize(met.select(*(F.col(f"o.{g}") for g in by), F.col("o.rank"), F.col("b.next").alias("prefix"), (F.col("o.before") + F.col("b.upto")).alias("before"), F.col("b.m").alias("size")))
        tables.append(open_)
    values = materialize(reduce(DataFrame.union, found))
    w = wanted.alias("w")
    for name, end in (("a", F.floor("place")), ("b", F.ceil("place"))):
        v = values.withColumnRenamed("value", name).alias("v")
        w = w.withColumn("__rank", end).alias("w").join(v, same("w", "v", [F.col("w.__rank") == F.col("v.rank")])).select(*(F.col(f"w.{g}") for g in by), *(F.col(f"w.{x}") for x in ("n", "i", "place")), *([F.col("w.a")] if name == "b" else []), F.col(f"v.{name}")).alias("w")
    at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    out = materialize(w.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == j, at)).alias(f"q{j}") for j in range(len(shares)))))
    release(*tables, values)
    return out


"""Joins that Spark has no single operator for: as-of, interpolation, nearest, IDW, mirror.

Nearest neighbours within a radius go through grid cells of that size, so each point meets
only those of its own and the adjoining cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, forward: bool = True) -> DataFrame:
    """Adds to each left row the value of the first right row at or after its time (or the last at or before).

    One union and one window over the key; no pair of rows is made that isn't in the result.
    """
    named = [c for c in left.columns]
    a = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)})
    b = right.select(key, time, F.col(value).alias("__v"), F.lit(0).alias("__left"))
    w = Window.partitionBy(key).orderBy(F.col(time).asc() if not forward else F.col(time).desc(), F.col("__left").asc()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(f"{value}_as_of", F.last("__v", ignorenulls=True).over(w)).where("__left = 1").select(*named, f"{value}_as_of")


def interpolate(clock: DataFrame, series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Series values at the clock's times, linear between samples and constant beyond the ends."""
    a = clock.select(key, time, F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__ask"))
    b = series.select(key, time, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__ask"))
    w = Window.partitionBy(key).orderBy(time, "__ask")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = F.when(F.col("__ask") == 0, F.col(time))
    out = a.union(b).withColumns({"v0": F.last("__v", True).over(before), "t0": F.last(t, True).over(before), "v1": F.first("__v", True).over(after), "t1": F.first(t, True).over(after)}).where("__ask = 1")
    share = F.try_divide(F.col(time) - F.col("t0"), F.col("t1") - F.col("t0"))
    return out.select(key, time, F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull() | (F.col("t1") == F.col("t0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias(value))


def _cells(df: DataFrame, size: float, around: bool) -> DataFrame:
    steps = F.sequence(F.lit(-1), F.lit(1)) if around else F.array(F.lit(0))
    cell = lambda c: F.floor(F.col(c) / size)
    return df.withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps)).withColumns({"__cx": cell("x") + F.col("__dx"), "__cy": cell("y") + F.col("__dy")}).drop("__dx", "__dy")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, by: list[str], left_key: str, right_key: str) -> DataFrame:
    """The nearest right point of the same group within a radius of each left point (ties: the least key); left points without one have NULL."""
    a = _cells(left.select(*by, F.col(left_key).alias("__a"), "x", "y"), radius, True)
    b = _cells(right.select(*by, F.col(right_key).alias("__b"), F.col("x"), F.col("y")), radius, False).withColumnsRenamed({"x": "__x", "y": "__y"})
    pairs = a.join(b, [*by, "__cx", "__cy"]).withColumn("distance", F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)).where(F.col("distance") <= radius)
    best = pairs.groupBy("__a").agg(F.min_by("__b", F.struct("distance", "__b")).alias(right_key + "_nearest"), F.min("distance").alias("distance"))
    return left.join(best, F.col(left_key) == F.col("__a"), "left").drop("__a")


def _joined_cells(left: DataFrame, right: DataFrame, by: list[str], size: str, reach: int) -> DataFrame:
    """Left points (__a, x, y) beside right ones (__b, __x, __y) of their own and the cells up to ``reach`` around, of ``size`` (a column of both)."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    cell = lambda c: F.floor(F.col(c) / F.col(size)).cast("long")
    a = left.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumns({"__cx": cell("x") + F.col("__dx"), "__cy": cell("y") + F.col("__dy")}).drop("__dx", "__dy")
    b = right.withColumns({"__cx": cell("__x"), "__cy": cell("__y")}).drop(size)
    return a.join(b, [*by, "__cx", "__cy"])


def k_nearest(targets: DataFrame, samples: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """``targets`` (key, x, y) beside their ``k`` nearest ``samples`` (__b, __x, __y, ...) of the same group: distance and rank (ties: the least __b).

    Samples are dealt to cells that hold about ``k`` each. A target looks at the cells
    around its own, and at more of them, twice as wide each time, until the k-th distance is
    within what the cells surely cover or they cover the whole group; so no target meets
    samples that are far away while nearer ones are known. Of samples at one place only the
    first ``k`` can be among the nearest, and only they go on.
    """
    place = Window.partitionBy(*by, "__x", "__y").orderBy("__b")
    samples = samples.withColumn("__p", F.row_number().over(place)).where(F.col("__p") <= k).drop("__p")
    box = samples.groupBy(*by).agg(*(f("__" + c).alias(m + c) for c in "xy" for m, f in (("__lo", F.min), ("__hi", F.max))), F.count("*").alias("__n"))
    area = F.greatest(F.col("__hix") - F.col("__lox"), F.lit(0.0)) * F.greatest(F.col("__hiy") - F.col("__loy"), F.lit(0.0))
    side = F.greatest(F.sqrt(area * k / F.col("__n")), F.greatest(F.col("__hix") - F.col("__lox"), F.col("__hiy") - F.col("__loy")) * k / F.col("__n"), F.lit(1e-9))
    sized = box.select(*by, side.alias("__size"), "__lox", "__hix", "__loy", "__hiy", "__n")
    waiting = targets.select(*by, F.col(key).alias("__a"), "x", "y").join(sized, by) if by else targets.select(F.col(key).alias("__a"), "x", "y").crossJoin(F.broadcast(sized))  # one row
    dealt = samples.join(sized.select(*by, "__size"), by) if by else samples.crossJoin(F.broadcast(sized.select("__size")))
    waiting, dealt, done = materialize(waiting), materialize(dealt), None
    w = Window.partitionBy(*by, "__a").orderBy("__d", "__b")
    for level in count():
        grown = lambda df: df.withColumn("__cell", F.col("__size") * F.lit(float(2**level)))  # noqa: E731,B023
        pairs = _joined_cells(grown(waiting), grown(dealt).drop("__size"), by, "__cell", 1)
        near = pairs.withColumn("__d", F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
        near = materialize(near.drop("__cx", "__cy"))
        edge = F.least(*(F.pmod(F.col(c), F.col("__cell")) + F.col("__cell") for c in "xy"), *(2 * F.col("__cell") - F.pmod(F.col(c), F.col("__cell")) for c in "xy"))  # how far all is seen
        whole = reduce(lambda a, b: a & b, ((F.floor(F.col(m + c) / F.col("__cell")) - F.floor(F.col(c) / F.col("__cell"))).between(-1, 1) for c in "xy" for m in ("__lo", "__hi")))
        ends = near.groupBy(*by, "__a").agg(F.count("*").alias("__m"), F.max("__d").alias("__far"))
        state = grown(waiting).join(ends, [*by, "__a"], "left")
        settled = materialize(state.where(whole | ((F.col("__m") >= k) & (F.col("__far") <= edge))).select(*by, "__a"))
        found = near.join(settled, [*by, "__a"], "left_semi")
        done = found if done is None else done.unionByName(found)
        waiting = materialize(waiting.join(settled, [*by, "__a"], "left_anti"))
        if waiting.isEmpty():
            break
    return done.drop("__size", "__cell", "__lox", "__hix", "__loy", "__hiy", "__n").withColumnsRenamed({"__a": key, "__d": "distance", "__r": "rank"})


def median_spacing(points: DataFrame, by: list[str], key: str) -> DataFrame:
    """Median distance of points to their nearest other point of the group; points at one place have no distance."""
    other = points.where("x is not null and y is not null")
    samples = other.select(*by, F.col(key).alias("__b"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    near = k_nearest(other, samples, key, by, 2).where((F.col(key) != F.col("__b")) & (F.col("distance") > 0))
    best = near.groupBy(*by, key).agg(F.min("distance").alias("d"))
    return best.groupBy(*by).agg(F.percentile("d", 0.5).alias("spacing"))


def weighted(near: DataFrame, key: str, value: str, power: float = 2.0) -> DataFrame:
    """Inverse-distance weighted mean of ``near`` (key, distance, value); a sample at no distance decides alone."""
    weight = F.try_divide(F.lit(1.0), F.pow("distance", F.lit(power)))
    apart = F.col("distance") >= 1e-9
    exact = F.max(F.when(~apart, F.col(value)))
    return near.groupBy(key).agg(F.coalesce(exact, F.try_divide(F.sum(F.when(apart, weight * F.col(value))), F.sum(F.when(apart, weight)))).alias(value))


def idw(targets: DataFrame, samples: DataFrame, key: str, value: str, k: int = 4, power: float = 2.0) -> DataFrame:
    """Inverse-distance weighted mean of the k nearest samples of each target, found by cells."""
    known = samples.where(F.col(value).isNotNull()).select(F.col(key).alias("__b"), F.col("x").alias("__x"), F.col("y").alias("__y"), value)
    return weighted(k_nearest(targets, known, key, [], k), key, value, power)


def mirror_pairs(points: DataFrame, key: str, axis: str = "x", digits: int = 4) -> DataFrame:
    """Pairs of points that mirror each other in an axis, each once."""
    sx, sy = (-1, 1) if axis == "x" else (1, -1)
    at = lambda c, s: F.round(F.col(c) * s, digits) + 0.0
    a = points.select(F.col(key).alias("a"), at("x", 1).alias("__x"), at("y", 1).alias("__y"))
    b = points.select(F.col(key).alias("b"), at("x", sx).alias("__x"), at("y", sy).alias("__y"))
    return a.join(b, ["__x", "__y"]).where("a < b").select("a", "b")


def angular_nearest(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The nearest direction of ``right`` for each of ``left`` (roll is the latitude, pitch the longitude), and the angle to it; NULL for a direction that is missing."""
    from .sphere import nearest

    rows = materialize(left.withColumn("__row", F.monotonically_increasing_id()))
    near = nearest(rows, "__row", right, key, 1).select("__row", F.col("other").alias("nearest"), "angle")
    return rows.join(near, "__row", "left").drop("__row")


def align_exact(cells: DataFrame, base_rev: int) -> DataFrame:
    """Cells of every revision beside those of the base at the same category and rounded place."""
    at = [F.col("category"), F.round("x", 6).alias("gx"), F.round("y", 6).alias("gy")]
    base = cells.where(F.col("rev") == base_rev).select(*at, F.col("key").alias("base_key"))
    return cells.where(F.col("rev") != base_rev).select("rev", "key", *at).join(base, ["category", "gx", "gy"], "full")


def normalized_name(c: Column) -> Column:
    """Lower case, other signs than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def match_names(left: DataFrame, right: DataFrame, explicit: DataFrame) -> DataFrame:
    """left_name, right_name: by the explicit table first, then by normalised names; names without a match have NULL."""
    a, b = left.select(F.col("name").alias("left_name")).distinct(), right.select(F.col("name").alias("right_name")).distinct()
    told = explicit.join(a, "left_name", "left_semi").join(b, "right_name", "left_semi").select("left_name", "right_name")
    rest_a, rest_b = a.join(told, "left_name", "left_anti"), b.join(told, "right_name", "left_anti")
    same = rest_a.withColumn("__n", normalized_name(F.col("left_name"))).join(rest_b.withColumn("__n", normalized_name(F.col("right_name"))), "__n", "full").select("left_name", "right_name")
    return told.union(same)

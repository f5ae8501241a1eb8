"""Directions on the sphere: nearest ones, coverage, and interpolation onto an even grid.

A direction is a latitude (roll) and a longitude (pitch) in degrees. Directions are dealt to
cubes around their points on the unit sphere; a target looks at the cubes around its own, and
at larger ones, until the k-th angle is within what these surely cover. No target meets all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize, release

#: Angles (degrees) under which two directions are one, and least angle of a weight.
EXACT, LEAST = 1e-3, 1e-9


def unit(roll: Column, pitch: Column) -> dict[str, Column]:
    r, p = F.radians(roll), F.radians(pitch)
    return {"x": F.cos(r) * F.cos(p), "y": F.cos(r) * F.sin(p), "z": F.sin(r)}


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two unit vectors."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def nearest(targets: DataFrame, key: str, samples: DataFrame, sample_key: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """key, other, angle, rank and the samples' columns ``keep``: the ``k`` nearest samples of each target (ties to nine digits: the least key).

    ``targets``: key (unique), roll, pitch. Directions with a missing angle take no part. Of
    samples in one direction only the first ``k`` can be among the nearest, and only they go on.
    """
    t = targets.where("roll is not null and pitch is not null").select(F.col(key).alias("__a"), *(v.alias(f"__t{c}") for c, v in unit(F.col("roll"), F.col("pitch")).items()))
    s = samples.where("roll is not null and pitch is not null").select(F.col(sample_key).alias("__b"), "roll", "pitch", *(F.col(c).alias(f"__keep_{c}") for c in keep))
    first = F.row_number().over(Window.partitionBy("roll", "pitch").orderBy("__b"))
    s = s.withColumn("__i", first).where(F.col("__i") <= k).select("__b", *(f"__keep_{c}" for c in keep), *(v.alias(f"__s{c}") for c, v in unit(F.col("roll"), F.col("pitch")).items()))
    waiting, s = materialize(t), materialize(s)
    total = s.count()
    size, out = max(math.sqrt(4 * math.pi * k / max(total, 1)), 1e-6), []
    cell = lambda p, side: {f"__c{c}": F.floor(F.col(f"__{p}{c}") / side).cast("long") for c in "xyz"}
    w = Window.partitionBy("__a").orderBy("__round", "__b")
    while total:
        size = min(size, 2.0)  # cubes of this side around any one hold the whole sphere
        around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(ds, "xyz", strict=True))) for ds in ((i, j, l) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)))))
        seen = waiting.withColumns(cell("t", size)).withColumn("__d", around).select("__a", *(f"__t{c}" for c in "xyz"), *((F.col(f"__c{c}") + F.col(f"__d.{c}")).alias(f"__c{c}") for c in "xyz"))
        pairs = seen.join(s.withColumns(cell("s", size)), [f"__c{c}" for c in "xyz"])
        at = angle([F.col(f"__t{c}") for c in "xyz"], [F.col(f"__s{c}") for c in "xyz"])
        near = pairs.select("__a", "__b", *(f"__keep_{c}" for c in keep), *(f"__t{c}" for c in "xyz"), at.alias("angle")).withColumn("__round", F.round("angle", 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = materialize(near)
        inside = F.least(*(F.pmod(F.col(f"__t{c}"), F.lit(size)) + size for c in "xyz"), *(2 * size - F.pmod(F.col(f"__t{c}"), F.lit(size)) for c in "xyz"))  # how far all is seen
        ends = near.groupBy("__a").agg(F.count("*").alias("m"), F.max("angle").alias("far"), F.first(inside).alias("edge"))
        chord = 2 * F.sin(F.radians("far") / 2)
        whole = F.lit(size >= 2.0)
        settled = materialize(ends.where(whole | ((F.col("m") >= k) & (chord < F.col("edge") - 1e-6))).select("__a"))
        out.append(near.join(settled, "__a", "left_semi"))
        if size >= 2.0:
            break
        waiting, gone = materialize(waiting.join(settled, "__a", "left_anti")), waiting
        release(gone)
        if waiting.isEmpty():
            break
        size *= 2
    kinds = [f"`{key}` {targets.schema[key].dataType.simpleString()}", f"other {samples.schema[sample_key].dataType.simpleString()}", "angle double", "rank int", *(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keep)]
    if not out:
        return targets.sparkSession.createDataFrame([], ", ".join(kinds))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select(F.col("__a").alias(key), F.col("__b").alias("other"), "angle", "rank", *(F.col(f"__keep_{c}").alias(c) for c in keep))


def coverage(directions: DataFrame, key: str = "i") -> DataFrame:
    """mean_nearest and largest_gap: mean and largest angle of a direction to its nearest other; coverage: how near that mean is to that of as many directions spread evenly, 1 at most."""
    near = nearest(directions, key, directions, key, 2).where(F.col(key) != F.col("other")).groupBy(key).agg(F.min("angle").alias("a"))
    ideal = F.degrees(F.sqrt(F.lit(4 * math.pi) / F.count("*")))
    covered = F.when(F.avg("a") > 0, F.least((ideal / F.avg("a")) ** 2, F.lit(1.0))).otherwise(0.0)
    return near.agg(F.avg("a").alias("mean_nearest"), F.max("a").alias("largest_gap"), covered.alias("coverage"))


def even_grid(spark: SparkSession, n: int) -> DataFrame:
    """n directions spread evenly by the golden angle: i, roll, pitch, rounded to six digits."""
    i = F.col("id")
    turn = F.pmod(i * math.degrees(math.pi * (3 - math.sqrt(5))), F.lit(360.0))
    return spark.range(n).select(i.alias("i"), F.round(F.degrees(F.asin(1 - (2 * i + 1) / n)), 6).alias("roll"), F.round(F.when(turn > 180, turn - 360).otherwise(turn), 6).alias("pitch"))


def interpolate(grid: DataFrame, key: str, samples: DataFrame, sample_key: str, value: str, k: int = 4, power: float = 2.0) -> DataFrame:
    """key, source, offset and value at each direction of a grid.

    A sample in the same direction gives its own value (source exact); else the ``k`` nearest
    are weighted by inverse angle to a power (source idw), of which those without a value
    count for nothing. offset is the angle to the nearest sample.
    """
    near = nearest(grid, key, samples, sample_key, k, [value])
    weight = F.when(F.col(value).isNotNull(), F.pow(F.greatest("angle", F.lit(LEAST)), F.lit(-power)))
    found = near.groupBy(key).agg(F.min("angle").alias("offset"), F.max(F.when(F.col("rank") == 1, F.col(value))).alias("__own"), F.try_divide(F.sum(weight * F.col(value)), F.sum(weight)).alias("__mean"))
    exact = F.col("offset") <= EXACT
    return found.select(key, F.when(exact, "exact").otherwise("idw").alias("source"), F.when(exact, 0.0).otherwise(F.round("offset", 6)).alias("offset"), F.when(exact, F.col("__own")).otherwise(F.col("__mean")).alias(value))

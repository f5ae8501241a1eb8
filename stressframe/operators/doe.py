"""Statistics over designs of experiments: results by face, position and part."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize
from .quantile import group_order_statistics, order_statistics


def summary(df: DataFrame, c: str, by: tuple[str, ...]) -> DataFrame:
    """n, max, percentiles, mean, population sd and its ratio to the mean; percentiles of all groups by rounds, none held as a whole."""
    plain = df.groupBy(*by).agg(F.count(c).alias("n"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.when(F.avg(c) != 0, F.try_divide(F.stddev_pop(c), F.avg(c))).alias("cov"))
    at = group_order_statistics(df, by, c, [0.95, 0.5, 0.25]).drop("n").alias("q")
    both = plain.alias("p").join(at, _same("p", "q", by), "left")
    return both.select(*(F.col(f"p.{g}") for g in by), "p.n", "p.max", F.col("q.q0").alias("p95"), F.col("q.q1").alias("p50"), F.col("q.q2").alias("p25"), "p.mean", "p.sd", "p.cov")


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in by))


def severity(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of metrics, each over its largest, clamped to 0 and 1; NULL without weights or measures."""
    top = df.agg(*(F.max(c).alias(f"__{c}") for c in weights))
    share = {c: F.when(F.col(f"__{c}") > 0, F.greatest(F.least(F.try_divide(F.col(c), F.col(f"__{c}")), F.lit(1.0)), F.lit(0.0))) for c in weights}
    there = sum((F.when(share[c].isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(share[c] * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(top)).withColumn("severity", F.when(there > 0, F.try_divide(total, there))).drop(*(f"__{c}" for c in weights))


def influence(df: DataFrame, c: str, limit: float, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(c) > limit).alias("influenced"), F.avg((F.col(c) > limit).cast("double")).alias("share"))


def weighted_centroid(df: DataFrame, weight: str, by: tuple[str, ...]) -> DataFrame:
    w = F.col(weight)
    return df.where(w > 0).groupBy(*by).agg(*(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"c{c}") for c in "xy"))


def upper_median(df: DataFrame, c: str, by: str, name: str) -> DataFrame:
    """The middle value of each group, the upper of two, and the size of the group (__n): by rounds, so no group is held or sorted at once."""
    return group_order_statistics(df, [by], c, [None]).select(by, F.col("q0").alias(name), F.col("n").alias("__n"))


def robust_outliers(df: DataFrame, c: str, by: str, threshold: float = 3.5, least: int = 8, most: int = 10) -> DataFrame:
    """Rows whose robust z is over the threshold, the ``most`` largest of each group of ``least`` or more; a feature of reports."""
    df = materialize(df)  # read several times
    med = upper_median(df, c, by, "median").where(F.col("__n") >= least)
    away = df.join(med, by).withColumn("__a", F.abs(F.col(c) - F.col("median")))
    mad = upper_median(away, "__a", by, "mad").drop("__n")
    z = away.join(mad, by).withColumn("z", F.when(F.col("mad") > 0, F.try_divide(0.6745 * (F.col(c) - F.col("median")), F.col("mad")))).where(F.abs("z") > threshold)
    return z.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs("z")), *[x for x in df.columns if x not in (by, c)]))).where(F.col("__r") <= most).drop("__r", "__a", "__n")


def tukey(df: DataFrame, c: str, by: str, k: float = 1.5, least: int = 4) -> DataFrame:
    """Rows outside the fences of their group, if it has ``least`` values."""
    q = group_order_statistics(df, [by], c, [0.25, 0.75]).where(F.col("n") >= least).select(by, F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    low, high = F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))
    return df.join(q, by).where((F.col(c) < low) | (F.col(c) > high)).withColumn("side", F.when(F.col(c) > high, "high").otherwise("low"))


def anomalies(df: DataFrame, c: str, by: str, threshold: float = 3.5) -> DataFrame:
    """Robust z of every row from true medians, and whether it is over the threshold."""
    df = materialize(df)  # read several times
    away = df.join(group_order_statistics(df, [by], c, [0.5]).select(by, F.col("q0").alias("median")), by).withColumn("__a", F.abs(F.col(c) - F.col("median")))
    mad = group_order_statistics(away, [by], "__a", [0.5]).select(by, F.col("q0").alias("mad"))
    out = away.join(mad, by).withColumn("z", F.when(F.col("mad") > 0, F.try_divide(0.6745 * (F.col(c) - F.col("median")), F.col("mad"))))
    return out.withColumn("anomalous", F.coalesce(F.abs("z") > threshold, F.lit(False))).drop("__a")


def correlations(df: DataFrame, item: str, at: list[str], c: str, top: int = 12) -> DataFrame:
    """Pearson correlation over positions of each pair of the ``top`` items by largest value; a feature of reports."""
    best = df.groupBy(item).agg(F.max(c).alias("__m")).orderBy(F.desc("__m"), item).limit(top).select(item)
    own = df.join(F.broadcast(best), item).groupBy(item, *at).agg(F.max(c).alias("v"))
    a, b = own.select(F.col(item).alias("a"), *at, F.col("v").alias("va")), own.select(F.col(item).alias("b"), *at, F.col("v").alias("vb"))
    return a.join(b, at).where("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))


def correlation_clusters(pairs: list[tuple], limit: float = 0.7) -> list[set]:
    """Greedy clusters of a correlation table of a few items: the pair of largest r first."""
    out: list[set] = []
    for a, b, r in sorted((p for p in pairs if p[2] is not None and p[2] > limit), key=lambda p: (-p[2], p[0], p[1])):
        home = next((c for c in out if a in c or b in c), None)
        if home is None:
            out.append({a, b})
        else:
            home |= {a, b}
    return out


def arrival(df: DataFrame, c: str, limit: float, top: int = 12) -> DataFrame:
    """First time over a limit by part, over runs: mean and sd, the earliest ``top`` parts; a feature of reports."""
    first = df.where(F.col(c) > limit).groupBy("run_id", "part_id").agg(F.min("t").alias("t"))
    return first.groupBy("part_id").agg(F.avg("t").alias("mean"), F.stddev_pop("t").alias("sd"), F.count("*").alias("n")).orderBy("mean", "part_id").limit(top)


def idw_surface(points: DataFrame, value: str, size: int = 31, power: float = 2.0) -> DataFrame:
    """Inverse-distance surface on a size x size grid over the points' box; points of one face are few."""
    box = points.agg(*(f(c).alias(k + c) for c in "xy" for k, f in (("a", F.min), ("b", F.max))))
    i = F.sequence(F.lit(0), F.lit(size - 1))
    grid = box.select("*", F.explode(i).alias("i")).select("*", F.explode(i).alias("j"))
    grid = grid.select("i", "j", (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("i") / (size - 1)).alias("gx"), (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("j") / (size - 1)).alias("gy"))
    pairs = points.select("x", "y", value).where(F.col(value).isNotNull()).crossJoin(F.broadcast(grid))  # size^2 rows
    d2 = (F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2
    w = 1 / F.pow(F.greatest(d2, F.lit(1e-18)), F.lit(power / 2))
    return pairs.groupBy("i", "j").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


#: Places of a block, of which a task meets two.
BLOCK = 4096


def leave_one_out(points: DataFrame, key: str, value: str, power: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """IDW estimate of each point from the other points of its group, such as a face.

    Points at one place are summed first: all pairs of places are met, in blocks, and a point
    takes itself out of its own place. Points of which that would not be exact (a key in
    several rows, a place with values that are not finite) meet all other points one by one.
    """
    points = points.select(*by, key, "x", "y", value).dropna(subset=[*by, key])
    place, v = [*by, "x", "y"], F.col(value).cast("double")
    weight = lambda x, y: 1 / F.pow(F.greatest((F.col("x") - F.col(x)) ** 2 + (F.col("y") - F.col(y)) ** 2, F.lit(1e-18)), F.lit(power / 2))
    places = materialize(points.groupBy(*place).agg(F.count("*").alias("__n"), F.count(value).alias("__held"), F.sum(v).alias("__s"))).withColumn("__odd", ~F.coalesce(F.abs("__s") < float("inf"), F.col("__held") == 0))
    blocks = -(-(places.groupBy(*by).count().agg(F.max("count")).first()[0] or 1) // BLOCK)
    each, block = F.sequence(F.lit(0), F.lit(blocks - 1)), F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int")
    one = places.select(*place, block.alias("__i"), F.explode(each).alias("__j")).repartition(min(blocks * blocks, 4096), "__i", "__j")
    two = places.select(*by, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("__n"), F.col("__s"), block.alias("__j"), F.explode(each).alias("__i"))
    pairs = one.join(two, [*by, "__i", "__j"]).where(~(F.col("x").eqNullSafe(F.col("__x")) & F.col("y").eqNullSafe(F.col("__y")))).withColumn("__w", weight("__x", "__y"))
    others = pairs.groupBy(*place).agg(F.sum(F.col("__w") * F.col("__s")).alias("__a"), F.sum(F.col("__w") * F.col("__n")).alias("__b"))
    alike = lambda names: [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names]
    known = places.alias("p").join(others.alias("o"), alike(place), "left").select(*(f"p.{c}" for c in [*place, "__n", "__held", "__s", "__odd"]), "__a", "__b")
    repeated = points.groupBy(*by, key).count().where("count > 1").select(*by, key, F.lit(True).alias("__again"))
    ready = points.join(repeated, [*by, key], "left").alias("p").join(known.alias("o"), alike(place)).select(*(f"p.{c}" for c in [*by, key, "x", "y", value]), "__again", "__n", "__held", "__s", "__odd", "__a", "__b")
    plain = ~F.coalesce("__again", "__odd")
    there = F.col("__held") > F.when(F.col(value).isNotNull(), 1).otherwise(0)  # values of others at the same place
    own = weight("x", "y")
    near = F.when(there, own * (F.col("__s") - F.coalesce(v, F.lit(0.0))))
    above = F.coalesce(F.col("__a") + near, "__a", near)
    below = F.coalesce("__b", F.lit(0.0)) + own * (F.col("__n") - 1)
    exact = ready.where(plain & ((F.col("__n") > 1) | F.col("__b").isNotNull())).select(*by, key, value, (above / below).alias("estimate"))
    if not repeated.limit(1).count() and not places.where("__odd").limit(1).count():
        return exact
    other = points.select(*(F.col(b).alias(f"__{b}") for b in by), F.col(key).alias("__k"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(value).alias("__v"))
    same = F.col(key) != F.col("__k")
    for b in by:
        same &= F.col(b) == F.col(f"__{b}")
    w = weight("__x", "__y")
    single = ready.where(~plain).join(other, same).groupBy(*by, key, value).agg((F.sum(w * F.col("__v")) / F.sum(w)).alias("estimate"))
    return exact.union(single)


def pareto(df: DataFrame, c: str, item: str = "part_id") -> DataFrame:
    """Severity (mean of what is over the global upper quartile) against coverage (its share) of each item; front marks those that no other beats in both."""
    df = materialize(df)  # read several times
    over = F.col(c) > F.lit(order_statistics(df, c, [0.75])[0]).cast("double")
    out = df.groupBy(item).agg(F.avg(F.when(over, F.col(c))).alias("severity"), F.avg(over.cast("double")).alias("coverage")).where("severity is not null")
    ahead = Window.orderBy(F.desc("coverage"), F.desc("severity"))  # a row for each item
    return out.withColumn("front", F.col("severity") > F.coalesce(F.max("severity").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))))


def energy_partition(df: DataFrame) -> DataFrame:
    """Share of internal and kinetic energy of each part of its run at the last time (run_id, part_id, t, ke, ie)."""
    last = df.groupBy("run_id", "part_id").agg(F.max_by("ke", "t").alias("ke"), F.max_by("ie", "t").alias("ie"))
    total = F.sum(F.col("ke") + F.col("ie")).over(Window.partitionBy("run_id"))
    return last.withColumns({"ke_share": F.try_divide(F.col("ke"), total), "ie_share": F.try_divide(F.col("ie"), total)})


def failure_risk(peaks: DataFrame, yields: DataFrame) -> DataFrame:
    """Safety factor yield / peak and its level; parts without a yield are ranked by their peak."""
    both = peaks.join(yields, "part_id", "left")
    sf = F.when(F.col("peak_stress") > 0, F.try_divide(F.col("yield_stress"), F.col("peak_stress")))
    level = F.when(F.col("safety").isNull(), "unknown").when(F.col("safety") < 1, "fail").when(F.col("safety") < 1.5, "risk").otherwise("ok")
    return both.withColumn("safety", sf).withColumn("level", level).withColumn("fallback_rank", F.when(F.col("safety").isNull(), F.rank().over(Window.partitionBy(F.col("safety").isNull()).orderBy(F.desc("peak_stress")))))


def damage(df: DataFrame, c: str, yields: DataFrame) -> DataFrame:
    """Sum of how far peaks are over the yield, as shares of it, by position."""
    return df.join(yields, "part_id").groupBy("face", "pos_id").agg(F.sum(F.greatest(F.try_divide(F.col(c), F.col("yield_stress")) - 1, F.lit(0.0))).alias("damage"))


def composite_damage(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Where no yield is known: by position, the sum over parts of the weighted metrics, each over its largest."""
    return severity(df, weights).groupBy("face", "pos_id").agg(F.sum("severity").alias("damage"))


def drill_down(df: DataFrame, yields: DataFrame) -> DataFrame:
    """Of each part: largest and mean acceleration, largest stress and displacement, the position of the largest acceleration (ties: the first), positions at or over the upper quartile of all, and the yield where it is known."""
    df = materialize(df)  # read several times
    quartile = order_statistics(df, "peak_g", [0.75])[0] or 0.0
    over = (F.col("peak_g") >= quartile) & F.lit(quartile > 0)
    out = df.groupBy("part_id").agg(
        F.max("peak_g").alias("max_peak_g"), F.avg("peak_g").alias("mean_peak_g"), F.max("peak_stress").alias("max_peak_stress"), F.max("peak_disp").alias("max_peak_disp"),
        F.min_by(F.struct("face", "pos_id"), F.struct(-F.col("peak_g"), "face", "pos_id")).alias("__at"), F.count_if(over).alias("over_quartile"),
    )
    return out.join(yields.select("part_id", "yield_stress"), "part_id", "left").select("part_id", "max_peak_g", "mean_peak_g", "max_peak_stress", "max_peak_disp", "__at.face", "__at.pos_id", "over_quartile", "yield_stress")


def boundary_effect(df: DataFrame, c: str, margin: float = 0.15) -> DataFrame:
    """Means of positions near the edge of their face and of those inside, and the ratio."""
    box = df.groupBy("face").agg(*(f(x).alias(k + x) for x in "xy" for k, f in (("a", F.min), ("b", F.max))))
    near = F.least(F.col("x") - F.col("ax"), F.col("bx") - F.col("x"), F.col("y") - F.col("ay"), F.col("by") - F.col("y")) <= margin * F.least(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    out = df.join(box, "face").groupBy("face").agg(F.avg(F.when(near, F.col(c))).alias("edge"), F.avg(F.when(~near, F.col(c))).alias("inside"))
    return out.withColumn("ratio", F.try_divide(F.col("edge"), F.col("inside")))


def worst_combinations(df: DataFrame, columns: dict[str, float], top: int = 25) -> DataFrame:
    """The ``top`` rows by a weighted sum of metrics over their 95th percentiles; a feature of reports."""
    df = materialize(df)  # read several times
    high = {c: F.lit(order_statistics(df, c, [0.95])[0]).cast("double") for c in columns}
    score = sum((F.coalesce(F.try_divide(F.col(c), high[c]) * w, F.lit(0.0)) for c, w in columns.items()), F.lit(0.0))
    return df.withColumn("score", score).orderBy(F.desc("score"), *[c for c in ("face", "pos_id", "part_id") if c in df.columns]).limit(top)


#: Fixed value: apparent speeds over this (m/s) are of delays too short to tell.
FASTEST = 12_000.0


def wave_samples(peaks: DataFrame, runs: DataFrame, positions: DataFrame) -> DataFrame:
    """pos_id, part_id, delay (s) and speed (m/s) of each part's peak behind the first contact.

    peaks: pos_id, part_id, t_peak and the part's first place x, y, z (mm). runs: pos_id,
    t_contact, the impactor's first z and behavior. positions: pos_id, x, y. Runs without
    contact, peaks not behind it, parts at no distance and speeds over FASTEST are no samples.
    """
    place = positions.select("pos_id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    hit = runs.where("behavior is null or behavior <> 'no-contact'").select("pos_id", "t_contact", F.coalesce("z", F.lit(0.0)).alias("__z"))
    both = peaks.join(hit, "pos_id").join(place, "pos_id").withColumn("delay", F.col("t_peak") - F.col("t_contact")).where("delay > 0")
    r = F.sqrt((F.col("__x") - F.col("x")) ** 2 + (F.col("__y") - F.col("y")) ** 2 + (F.col("__z") - F.col("z")) ** 2)
    speed = r / F.col("delay") / 1000
    return both.select("pos_id", "part_id", "delay", speed.alias("speed")).where((F.col("speed") > 0) & (F.col("speed") <= FASTEST))


def wave_speed(peaks: DataFrame, runs: DataFrame, positions: DataFrame) -> DataFrame:
    """Apparent wave speed by part: mean, median and quartiles over the impacts, mean delay, samples. A part has a sample for each position at most."""
    q = lambda share: F.percentile("speed", share)
    return wave_samples(peaks, runs, positions).groupBy("part_id").agg(F.avg("speed").alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.avg("delay").alias("mean_delay"), F.count("*").alias("samples"))


def _finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


#: Fixed values of the recommendations: percent of asymmetry that is told and that is critical, of absorption that is low and that is enough, shares of the yield that are told, warn and are critical, and how many deviations from the mean, of how many positions at least, are apart.
ASYMMETRY, ABSORPTION, OF_YIELD, APART, POSITIONS = (15.0, 30.0), (30.0, 50.0), (0.6, 0.8, 1.0), 2.5, 4


def recommendations(results: DataFrame, positions: DataFrame, quality: DataFrame | None = None, runs: DataFrame | None = None, yields: DataFrame | None = None) -> DataFrame:
    """rule, severity, metric and subject of every rule that applies.

    results: pos_id, part_id, peak_g, peak_stress. positions: pos_id, x. quality: impact_visible
    and verdict of each run. runs: ke_retention and behavior. yields: part_id, yield_stress.
    Each rule is an aggregation to a row; values that are not finite are passed over.
    """
    row = lambda df, rule, severity, metric, subject=F.lit(None): df.select(F.lit(rule).alias("rule"), severity.alias("severity"), metric.cast("double").alias("metric"), subject.cast("string").alias("subject"))
    out = []
    if quality is not None:
        n = quality.agg(F.count_if(~F.col("impact_visible")).alias("unseen"), F.count_if(F.col("verdict") == "fail").alias("failed"))
        out += [row(n.where(f"{c} > 0"), rule, F.lit("critical"), F.col(c)) for rule, c in (("runs without contact", "unseen"), ("energy balance fails", "failed"))]
    real = results.select("pos_id", "part_id", _finite("peak_g").alias("g"), _finite("peak_stress").alias("s"))
    worst = real.where("g is not null").groupBy().agg(F.max("g").alias("g"), F.min_by(F.struct("pos_id", "part_id"), F.struct(-F.col("g"), "pos_id", "part_id")).alias("at")).where("g is not null")
    out.append(row(worst, "largest response", F.lit("critical"), F.round("g", 1), F.concat_ws("/", F.col("at.pos_id").cast("string"), F.col("at.part_id").cast("string"))))  # the largest is over any percentile
    means = real.where("g is not null and pos_id is not null").groupBy("pos_id").agg(F.avg("g").alias("m"))
    sides = means.join(positions.select("pos_id", _finite("x").alias("x")), "pos_id").agg(F.avg(F.when(F.col("x") < 0, F.col("m"))).alias("l"), F.avg(F.when(F.col("x") > 0, F.col("m"))).alias("r"))
    asymmetry = sides.select(F.when(F.col("l") + F.col("r") > 0, F.abs(F.col("l") - F.col("r")) / ((F.col("l") + F.col("r")) / 2) * 100).alias("a")).where(F.col("a") > ASYMMETRY[0])
    out.append(row(asymmetry, "asymmetry along x", F.when(F.col("a") < ASYMMETRY[1], "warning").otherwise("critical"), F.round("a", 1)))
    if runs is not None:
        taken = runs.where("behavior is null or behavior <> 'no-contact'").agg(((1 - F.avg(_finite("ke_retention"))) * 100).alias("a")).where("a is not null")
        out.append(row(taken, "energy absorption", F.when(F.col("a") < ABSORPTION[0], "warning").otherwise("info"), F.round("a", 1), F.when(F.col("a") < ABSORPTION[1], "low").otherwise("enough")))
    if yields is not None:
        of = real.where("s is not null").join(yields.where("yield_stress > 0"), "part_id").groupBy("part_id").agg(F.max(F.col("s") / F.col("yield_stress")).alias("d"))
        top = of.groupBy().agg(F.max("d").alias("d"), F.min_by("part_id", F.struct(-F.col("d"), "part_id")).alias("p")).where(F.col("d") >= OF_YIELD[0])
        out.append(row(top, "share of the yield", F.when(F.col("d") >= OF_YIELD[2], "critical").when(F.col("d") >= OF_YIELD[1], "warning").otherwise("info"), F.round("d", 2), F.col("p")))
    spread = means.agg(F.count("*").alias("n"), F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd")).where((F.col("n") >= POSITIONS) & (F.col("sd") > 0))
    apart = means.crossJoin(F.broadcast(spread)).agg(F.count_if(F.abs((F.col("m") - F.col("mu")) / F.col("sd")) > APART).alias("n")).where("n > 0")  # one row
    out.append(row(apart, "positions apart", F.lit("warning"), F.col("n")))
    return reduce(DataFrame.unionByName, out)


def safe_zone(df: DataFrame, c: str, limit: float) -> DataFrame:
    """Positions of each face where no part is over a limit."""
    return df.groupBy("face", "pos_id", "x", "y").agg(F.max(c).alias("worst")).where((F.col("worst") <= limit) & F.col("worst").isNotNull())


def drop_zones(results: DataFrame, behavior: DataFrame | None = None, impactor: object = None) -> DataFrame:
    """face, pos_id, status (safe, at-risk or no-contact), and metric, value and part of the worst violation at each position.

    results: face, pos_id, part_id, peak_g, peak_stress, peak_disp; rows of the ``impactor`` are
    left out. A value is a violation where it is over the mean of all accelerations, or the upper
    quartile of all stresses or displacements; the worst is the largest as a share of its
    threshold (ties: the least part, then in this order). Positions of runs without contact
    (``behavior``: pos_id, behavior) are neither safe nor at risk. Without a finite value of
    each metric there are no rows.
    """
    rows = results if impactor is None else results.where(~F.col("part_id").eqNullSafe(F.lit(impactor)))
    metrics = ("peak_g", "peak_stress", "peak_disp")
    real = materialize(rows.select("face", "pos_id", "part_id", *(_finite(c).alias(c) for c in metrics)))
    limits = (real.agg(F.avg("peak_g")).first()[0], *(order_statistics(real, c, [0.75])[0] for c in metrics[1:]))
    if None in limits:
        return real.limit(0).select("face", "pos_id", F.lit("").alias("status"), F.lit("").alias("worst_metric"), F.col("peak_g").alias("worst_value"), F.col("part_id").alias("worst_part"))
    share = lambda c, k: F.when(F.col(c) > limits[k], F.col(c) / limits[k] if limits[k] > 0 else F.col(c))
    over = F.array(*(F.struct((-share(c, k)).alias("less"), F.col("part_id").alias("part"), F.lit(k).alias("k"), F.lit(c).alias("metric"), F.col(c).alias("value")) for k, c in enumerate(metrics)))
    found = real.select("face", "pos_id", F.array_min(F.filter(over, lambda v: v["less"].isNotNull())).alias("v")).groupBy("face", "pos_id").agg(F.min("v").alias("v"))
    names = behavior.where("behavior = 'no-contact'").select("pos_id", F.lit(True).alias("__none")).distinct() if behavior is not None else None
    found = found.join(names, "pos_id", "left") if names is not None else found.withColumn("__none", F.lit(None).cast("boolean"))
    none = F.coalesce("__none", F.lit(False))
    status = F.when(none, "no-contact").when(F.col("v").isNull(), "safe").otherwise("at-risk")
    return found.select("face", "pos_id", status.alias("status"), *(F.when(~none, F.col("v")[c]).alias(f"worst_{n}") for c, n in (("metric", "metric"), ("value", "value"), ("part", "part"))))


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """Corners of the convex hull of each group's points, counter-clockwise, none of fewer than three points; a face's positions are few."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = sorted(set(zip(frame["x"], frame["y"], strict=True)))

        def chain(points):
            out: list = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1] if len(points) > 1 else out

        hull = chain(p) + chain(p[::-1]) if len(p) > 2 else []
        return pd.DataFrame({by: [frame[by].iloc[0]] * len(hull), "i": range(len(hull)), "x": [a for a, _ in hull], "y": [b for _, b in hull]})

    kind = points.schema[by].dataType.simpleString()
    return points.select(by, "x", "y").dropna().groupBy(by).applyInPandas(run, f"{by} {kind}, i int, x double, y double")


def k_means(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """cluster of each row, by the library's k-means|| and Lloyd steps."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(ready).transform(ready).drop("__v")


def assign_clusters(df: DataFrame, columns: list[str], centres: list[list[float]]) -> DataFrame:
    """Adds cluster, the nearest of a few centres (ties: the first), and its squared distance; NULL where a column is missing."""
    d2 = [sum(((F.col(c) - v) ** 2 for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    rows = df.withColumns({f"__d{k}": d for k, d in enumerate(d2)})
    least = F.least(*(F.col(f"__d{k}") for k in range(len(centres)))) if len(centres) > 1 else F.col("__d0")
    own = F.coalesce(*(F.when(F.col(f"__d{k}") == F.col("__least"), k) for k in range(len(centres))))
    return rows.withColumn("__least", least).withColumns({"cluster": own, "distance2": F.col("__least")}).drop("__least", *(f"__d{k}" for k in range(len(centres))))


def scatter_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, the scale of each column (its largest size), and the sums and sums of products of the columns over their scales, of rows without a missing value."""
    n = len(columns)
    top = df.agg(*(F.max(F.abs(c)).alias(f"scale_{i}") for i, c in enumerate(columns)))
    scaled = [F.col(c) / F.when(F.col(f"scale_{i}") > 0, F.col(f"scale_{i}")).otherwise(1.0) for i, c in enumerate(columns)]
    sums = [F.sum(a).alias(f"sum_{i}") for i, a in enumerate(scaled)] + [F.sum(scaled[i] * scaled[j]).alias(f"product_{i}_{j}") for i in range(n) for j in range(i, n)]
    return df.dropna(subset=columns).crossJoin(F.broadcast(top)).agg(F.count("*").alias("n"), *(F.max(f"scale_{i}").alias(f"scale_{i}") for i in range(n)), *sums)  # one row


def principal_components(df: DataFrame, columns: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Modes (k x columns, largest entry positive) and their shares of the variance, of columns over their largest values.

    The scatter matrix is summed on executors; only it, of the size of the columns, is collected.
    """
    n = len(columns)
    row = scatter_matrix(df, columns).first()
    if not row["n"]:
        return np.zeros((0, n)), np.zeros(0)
    mean = np.array([row[f"sum_{i}"] for i in range(n)]) / row["n"]
    scatter = np.array([[row[f"product_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / row["n"] - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(scatter)
    modes = vectors[:, ::-1][:, :k].T
    modes *= np.sign(modes[np.arange(len(modes)), np.abs(modes).argmax(1)])[:, None]
    return modes, values[::-1][:k] / max(values.sum(), 1e-300)


def sphere_findings(parts: DataFrame, g_limit: float = 1000.0) -> DataFrame:
    """severity and finding of each part: peak_stress, yield_stress, peak_g."""
    sf = F.try_divide(F.col("yield_stress"), F.col("peak_stress"))
    finding = F.when(sf < 1, "over the yield").when(sf < 1.5, "safety factor under 1.5").when(F.col("peak_g") > g_limit, "G over the limit")
    return parts.select("part_id", F.when(sf < 1, "critical").when(finding.isNotNull(), "warning").otherwise("info").alias("severity"), finding.alias("finding"))


def angle_category(name: Column) -> Column:
    """The kind of a direction by the first letter of its name."""
    kinds = {"F": "face", "E": "edge", "C": "corner", "P": "fibonacci"}  # fixed values
    known = F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv))
    return F.coalesce(known[F.substring(name, 1, 1)], F.lit("unknown"))

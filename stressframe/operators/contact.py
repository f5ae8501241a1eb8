"""Contact forces, impactor trajectories and what is read from them.

Forces: run_id, interface_id, side (0 and 1, -1 for the total), t, fx, fy, fz. Trajectories:
run_id, t, pos_x.., vel_x.., ke, contact_engaged. What was not measured is NULL, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import as_of

#: Parameter: contact holds while a force is at least this share of its own peak.
ENGAGED = 0.01


def _total_or_sides(forces: DataFrame) -> DataFrame:
    """Only the totals of runs that have some, so that a contact counts once; all sides of other runs."""
    totals = forces.where("side = -1").select(F.col("run_id").alias("__run")).distinct()
    both = forces.join(totals, F.col("run_id") == F.col("__run"), "left")
    return both.where(F.col("__run").isNull() | (F.col("side") == -1)).drop("__run")


def contact_mask(forces: DataFrame, clock: DataFrame, share: float = 0.1, times: float = 5.0) -> DataFrame:
    """``clock`` (run_id, t) with engaged: if any contact's force is over its threshold at the first sample from then on.

    A force is the sum of its components' sizes. The threshold is the larger of a share of the
    peak and so many times the middle (the upper of two) of the lowest fifth of the samples,
    which is what a preload leaves. Times outside a series are not engaged.
    """
    size = F.abs("fx") + F.abs("fy") + F.abs("fz")
    key = F.concat_ws("/", "run_id", "interface_id", "side")
    rows = _total_or_sides(forces).select("run_id", key.alias("series"), "t", size.alias("f"))
    ranked = rows.select("series", "f", (F.row_number().over(Window.partitionBy("series").orderBy("f")) - 1).alias("i"), F.count("*").over(Window.partitionBy("series")).alias("n"))
    middle = F.floor(F.greatest(F.lit(1), F.floor(F.col("n") / 5)) / 2)
    base = ranked.where(F.col("i") == middle).select("series", F.col("f").alias("base"))
    ends = rows.groupBy("run_id", "series").agg(F.max("f").alias("peak"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    limits = ends.where("peak > 0").join(base, "series").select("run_id", "series", "t0", "t1", F.greatest(share * F.col("peak"), times * F.col("base")).alias("limit"))
    asked = clock.select("run_id", "t").distinct().join(limits, "run_id").where("t between t0 and t1")  # a row for each contact of the run
    found = as_of(asked, rows, "series", "t", "f").where(F.col("f_as_of") > F.col("limit")).select("run_id", "t").distinct()
    return clock.join(found.withColumn("engaged", F.lit(True)), ["run_id", "t"], "left").withColumn("engaged", F.coalesce("engaged", F.lit(False)))


def contact_metrics(forces: DataFrame, by: tuple[str, ...] = ("run_id", "interface_id")) -> DataFrame:
    """Of each contact: the side with the larger peak (ties: the lower), its peak, time of the peak, impulse, first and last time engaged, and the balance of the two sides.

    The balance is the difference of the sides' impulses as a share of the larger. Where one
    side has all but no force the definition leaves it out: one_sided, and no balance.
    """
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    w = Window.partitionBy(*by, "side").orderBy("t")
    rows = forces.withColumn("f", size)
    rows = rows.withColumns({"step": (F.col("t") - F.lag("t").over(w)) * (F.col("f") + F.lag("f").over(w)) / 2, "own": F.max("f").over(Window.partitionBy(*by, "side"))})
    on = (F.col("own") > 0) & (F.col("f") >= ENGAGED * F.col("own"))
    each = rows.groupBy(*by, "side").agg(
        F.max("f").alias("peak"), F.min(F.when(F.col("f") == F.col("own"), F.col("t"))).alias("t_peak"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("impulse"),
        F.min(F.when(on, F.col("t"))).alias("t_first"), F.max(F.when(on, F.col("t"))).alias("t_last"), F.count("*").alias("samples"),
    )
    rank = F.struct((F.col("side") >= 0).cast("int"), F.col("peak"), -F.col("side"))  # sides before totals
    one, other = (F.max(F.when(F.col("side") == k, F.struct("peak", "impulse"))) for k in (0, 1))
    best = each.groupBy(*by).agg(F.max_by(F.struct("side", "peak", "t_peak", "impulse", "t_first", "t_last", "samples"), rank).alias("b"), one.alias("x"), other.alias("y"), F.count_if(F.col("side") >= 0).alias("sides"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    low, high = F.least("x.peak", "y.peak"), F.greatest("x.peak", "y.peak")
    larger = F.greatest(F.abs("x.impulse"), F.abs("y.impulse"))
    balance = F.when(both & (low >= ENGAGED * high), F.when(larger == 0, 0.0).otherwise(F.try_divide(F.abs(F.col("x.impulse") - F.col("y.impulse")), larger)))
    return best.select(
        *by, F.col("b.side").alias("side_used"), F.col("b.peak").alias("peak_force"), F.col("b.t_peak").alias("t_peak"), F.col("b.impulse").alias("impulse"), F.col("b.t_first").alias("t_engaged"), F.col("b.t_last").alias("t_released"),
        F.col("b.samples").alias("samples"), "sides", F.coalesce(both & (low < ENGAGED * high), F.lit(False)).alias("one_sided"), balance.alias("balance"),
    )


def contact_checks(metrics: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Of each run: contacts checked for balance, those of one side, the largest and the upper middle balance; and when contacts engage and peak."""
    checked = F.count("balance")
    ranked = metrics.withColumns({"__i": F.row_number().over(Window.partitionBy(*by, F.col("balance").isNull()).orderBy("balance", "interface_id")) - 1, "__n": checked.over(Window.partitionBy(*by))})
    middle = F.max(F.when(F.col("balance").isNotNull() & (F.col("__i") == F.floor(F.col("__n") / 2)), F.col("balance")))
    peak = F.when(F.col("peak_force") > 0, F.col("t_peak"))
    return ranked.groupBy(*by).agg(
        F.count("balance").alias("checked"), F.count_if(F.col("one_sided") | (F.col("sides") < 2)).alias("one_sided"), F.max("balance").alias("max_balance"), middle.alias("median_balance"),
        F.count("t_engaged").alias("engaged"), F.min("t_engaged").alias("first_engaged"), F.min(peak).alias("first_peak"), F.max(peak).alias("last_peak"), F.when(F.count(peak) > 1, F.max(peak) - F.min(peak)).alias("peak_spread"),
    )


def trajectory_summary(trajectories: DataFrame) -> DataFrame:
    """Of each run: first contact, energy before and after, retention, incident and rebound speed, depth, last velocities and the sign of the incidence.

    The time before contact includes its first sample; its largest energy and speed count, as
    a first state is often at rest. Without a contact all samples are before it.
    """
    speed = F.sqrt(sum((F.col(f"vel_{c}") * F.col(f"vel_{c}") for c in "xyz"), F.lit(0.0)))
    contact = F.min(F.when(F.col("contact_engaged"), F.col("t"))).over(Window.partitionBy("run_id"))
    rows = trajectories.withColumns({"speed": speed, "t_contact": contact})
    before = F.col("t_contact").isNull() | (F.col("t") <= F.col("t_contact"))
    reference = F.coalesce(F.max(F.when(F.col("t") == F.col("t_contact"), F.col("pos_z"))), F.min_by("pos_z", "t"))
    out = rows.groupBy("run_id").agg(
        F.min("t_contact").alias("t_contact"), F.coalesce(F.max(F.when(before & (F.col("ke") > 0), F.col("ke"))), F.min_by("ke", "t")).alias("ke_before"), F.max_by("ke", "t").alias("ke_after"),
        F.max(F.when(before, F.col("speed"))).alias("incident_speed"), F.max_by("speed", "t").alias("rebound_speed"), *(F.max_by(f"vel_{c}", "t").alias(f"last_v{c}") for c in "xyz"),
        F.min_by("vel_z", F.when(F.abs("vel_z") > 1e-12, F.col("t"))).alias("first_vz"), F.greatest(reference - F.min("pos_z"), F.lit(0.0)).alias("depth"),
    )
    return out.withColumn("ke_retention", F.when(F.col("ke_before") > 0, F.try_divide(F.col("ke_after"), F.col("ke_before"))).otherwise(0.0))


#: Parameters of ``behavior``: least retention and vertical speed (of the incident) of a bounce, most of an embedding, least retention of a slide, of an untouched run.
BOUNCE, EMBED, SLIDE, UNTOUCHED = (0.40, 0.05), (0.15, 0.01), 0.15, 0.995


def behavior(summary: DataFrame) -> DataFrame:
    """no-contact, bounce, embed, slide or rebound, the first rule that holds; unknown without an incident speed."""
    kept, up = F.col("ke_retention"), F.try_divide(F.abs("last_vz"), F.col("incident_speed"))
    onward = F.col("last_vz") * F.coalesce(F.signum("first_vz"), F.lit(-1.0)) > 0
    aside = F.sqrt(F.col("last_vx") * F.col("last_vx") + F.col("last_vy") * F.col("last_vy"))
    rule = (
        F.when(F.coalesce(F.col("incident_speed"), F.lit(0.0)) <= 0, "unknown")
        .when((kept >= UNTOUCHED) & (F.col("t_contact").isNull() | (onward & (up >= 0.9))), "no-contact")
        .when((kept >= BOUNCE[0]) & (up >= BOUNCE[1]), "bounce")
        .when((kept < EMBED[0]) & (up < EMBED[1]), "embed")
        .when((aside > F.abs("last_vz")) & (kept >= SLIDE), "slide")
        .otherwise("rebound")
    )
    return summary.withColumn("behavior", rule)


def restitution(summary: DataFrame) -> DataFrame:
    """The root of the energy kept."""
    return summary.withColumn("restitution", F.when(F.col("ke_before") > 0, F.sqrt(F.try_divide(F.col("ke_after"), F.col("ke_before")))))


def rebound_field(positions: DataFrame, summary: DataFrame) -> DataFrame:
    """``positions`` (run_id, x, y) with the velocity after impact: up, down or flat by 5 % of the incident speed or 0.1, and sliding where it goes aside; NULL without a trajectory."""
    speed = F.sqrt(F.col("last_vx") * F.col("last_vx") + F.col("last_vy") * F.col("last_vy"))
    limit = F.greatest(0.05 * F.abs("incident_speed"), F.lit(0.1))
    rows = positions.join(summary.select("run_id", "last_vx", "last_vy", "last_vz", "incident_speed"), "run_id", "left").withColumn("speed", speed)
    course = F.when(F.col("last_vz") > limit, "up").when(F.col("last_vz") < -limit, "down").when(F.col("last_vz").isNotNull(), "flat")
    top = rows.agg(F.max("speed").alias("__top"))
    marked = rows.crossJoin(F.broadcast(top))  # one row
    sliding = (F.col("speed") > F.greatest(F.abs("last_vz"), F.lit(1e-6))) & (F.col("speed") > 0.05 * F.greatest("__top", F.lit(1e-6)))
    return marked.select(*positions.columns, F.col("last_vx").alias("vx"), F.col("last_vy").alias("vy"), F.col("last_vz").alias("vz"), "speed", course.alias("course"), sliding.alias("sliding"))


def trajectory_bundles(trajectories: DataFrame, most: int = 30) -> DataFrame:
    """At most ``most`` points of each run, evenly over its samples, the first and the last among them: a feature of plots."""
    w = Window.partitionBy("run_id")
    rows = trajectories.where("pos_x is not null and pos_y is not null and pos_z is not null")
    rows = rows.withColumns({"__i": (F.row_number().over(w.orderBy("t")) - 1).cast("long"), "__n": F.count("*").over(w)})
    step = (F.col("__n") - 1) / F.lit(most - 1)
    near = F.bround(F.col("__i") / step).cast("long")  # the only multiple of the step that can round to this place
    there = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < most) & (F.bround(k * step).cast("long") == F.col("__i")))
    return rows.where((F.col("__n") <= most) | there | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")


def along_trajectory(motion: DataFrame, summary: DataFrame, positions: DataFrame, peaks: DataFrame) -> DataFrame:
    """Positions with what their runs' trajectories and part motions have: the delay of each part's peak after first contact.

    ``positions``: run_id, x, y; ``peaks``: run_id, part_id, t_peak. Parts are there for
    every position that has a trajectory with a contact; ``motion`` adds its columns by run
    and part where it has them.
    """
    timed = positions.join(summary.where("t_contact is not null").select("run_id", "t_contact", "behavior"), "run_id")
    each = timed.join(peaks, "run_id").withColumn("delay", F.col("t_peak") - F.col("t_contact"))
    return each.join(motion, ["run_id", "part_id"], "left")


def contact_profile(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Pair by position: peak force, impulse and work of each pair of parts at every position, NULL where they do not touch.

    ``edges``: run_id, src, dst, peak_force, impulse, work. place is the rank of a pair:
    pairs of two parts (whole numbers) first, then by largest peak force, then by name.
    """
    pair = F.concat("src", F.lit(">"), "dst")
    whole = F.col("src").rlike(r"^\d+$") & F.col("dst").rlike(r"^\d+$")
    own = edges.join(positions.select("run_id"), "run_id", "left_semi").withColumn("pair", pair)
    pairs = own.groupBy("pair", "src", "dst").agg(F.max("peak_force").alias("top"), F.first(whole).alias("resolved"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("resolved"), F.desc("top"), "pair")))  # a row for each pair of parts
    grid = ranked.crossJoin(positions.select("run_id"))  # the matrix itself
    cells = own.groupBy("run_id", "pair").agg(*(F.max(c).alias(c) for c in ("peak_force", "impulse", "work")))
    return grid.join(cells, ["run_id", "pair"], "left").select("pair", "place", "resolved", "run_id", "peak_force", "impulse", "work")


def audit_level(value: Column, warn: float, fail: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")

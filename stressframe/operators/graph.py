"""Energy graphs: vertices and edges as DataFrames, iterative relations with cut lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import materialize


def depths(edges: DataFrame, source: DataFrame, most: int | None = None) -> DataFrame:
    """Breadth-first depth of each vertex that can be reached from ``source`` (id), edges (src, dst) taken both ways; to depth ``most`` where it is given."""
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    found = materialize(source.select(F.col("id"), F.lit(0).alias("depth")).distinct())
    frontier = found
    for depth in count(1) if most is None else range(1, most + 1):
        reached = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(reached.join(found, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = materialize(found.union(frontier))
    return found


def cheapest_paths(edges: DataFrame, source: DataFrame, rounds: int | None = None) -> DataFrame:
    """Least cost and predecessor of each vertex; an edge costs the inverse of its impulse. Relaxed until nothing changes.

    Costs that do not settle within ``rounds``, or in as many as there are vertices, as with a negative impulse, are an error.
    """
    cost = 1 / (F.col("impulse") + 1e-12)
    both = materialize(edges.select("src", "dst", cost.alias("w")).union(edges.select("dst", "src", cost.alias("w"))).groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = materialize(source.select("id", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["src"].dataType).alias("previous")).distinct())
    last = None
    for _ in range(both.select("src").distinct().count() + 2 if rounds is None else rounds):
        steps = best.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("previous"))
        best = materialize(best.union(steps).groupBy("id").agg(F.min_by("previous", F.struct("cost", "previous")).alias("previous"), F.min("cost").alias("cost")).select("id", "cost", "previous"))
        state = best.agg(F.count("*"), F.sum(F.xxhash64("id", "cost", "previous").cast("decimal(38,0)"))).first()
        if state == last:
            return best
        last = state
    raise RuntimeError("costs did not settle")


def ring_layout(found: DataFrame, radius: float = 1.0) -> DataFrame:
    """Places on rings by depth, evenly by id."""
    w = Window.partitionBy("depth")
    turn = 2 * 3.141592653589793 * (F.row_number().over(w.orderBy("id")) - 1) / F.count("*").over(w)
    r = F.col("depth") * radius
    return found.withColumns({"px": r * F.cos(turn), "py": r * F.sin(turn)})


def flow_edges(contacts: DataFrame) -> DataFrame:
    """Impulse, work and peak of each contact pair from samples (src, dst, t, force, velocity), by trapezoids."""
    w = Window.partitionBy("src", "dst").orderBy("t")
    dt = F.col("t") - F.lag("t").over(w)
    half = lambda c: (F.col(c) + F.lag(c).over(w)) / 2 * dt
    ready = contacts.withColumn("power", F.col("force") * F.col("velocity")).withColumns({"__i": half("force"), "__w": half("power")})
    return ready.groupBy("src", "dst").agg(F.sum("__i").alias("impulse"), F.sum("__w").alias("work"), F.max("force").alias("peak_force"))


def first_engaged(contacts: DataFrame, threshold: float) -> DataFrame:
    """First time that the force of each pair is over a threshold."""
    return contacts.where(F.abs("force") > threshold).groupBy("src", "dst").agg(F.min("t").alias("t_engaged"))


def energy_residual(energies: DataFrame) -> DataFrame:
    """Total energy at the last time less that at the first, and as a share, from (run_id, t, ke, ie, hourglass, sliding)."""
    total = F.coalesce("ke", F.lit(0.0)) + F.coalesce("ie", F.lit(0.0)) + F.coalesce("hourglass", F.lit(0.0)) + F.coalesce("sliding", F.lit(0.0))
    ends = energies.withColumn("total", total).groupBy("run_id").agg(F.min_by("total", "t").alias("first"), F.max_by("total", "t").alias("last"))
    return ends.withColumns({"residual": F.col("last") - F.col("first"), "residual_pct": F.when(F.col("first") != 0, F.try_divide(F.col("last") - F.col("first"), F.abs("first")) * 100)})

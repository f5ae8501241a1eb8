"""Comparison of revisions: differences, trends, ranks, transitions, findings, tiers.

Long tables keyed by rev; NULL is "not measured" and is never counted as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metrics of which the least value is the worst: compressive ones.
COMPRESSIVE = frozenset({"s3", "e3"})


def deltas(cells: DataFrame, metric: str, base_rev: int, key: str = "key") -> DataFrame:
    """Each revision's value beside the base's: delta, and delta_pct, NULL where the base is 0."""
    base = F.max(F.when(F.col("rev") == base_rev, F.col(metric))).over(Window.partitionBy(key))
    d = F.col(metric) - F.col("base")
    return cells.select("rev", key, metric, base.alias("base")).withColumns({"delta": d, "delta_pct": F.when(F.col("base") != 0, F.try_divide(d, F.abs("base")) * 100)})


def spread(cells: DataFrame, metric: str, key: str = "key") -> DataFrame:
    """min, max, range, population sd and its ratio to the mean over revisions."""
    return cells.groupBy(key).agg(F.min(metric).alias("min"), F.max(metric).alias("max"), (F.max(metric) - F.min(metric)).alias("range"), F.stddev_pop(metric).alias("sd"), F.when(F.avg(metric) != 0, F.try_divide(F.stddev_pop(metric), F.abs(F.avg(metric)))).alias("cv"))


def trend(cells: DataFrame, metric: str, base_rev: int, key: str = "key") -> DataFrame:
    """Least-squares slope over the revision number, and as a share of the base."""
    out = cells.groupBy(key).agg(F.regr_slope(metric, F.col("rev").cast("double")).alias("slope"), F.max(F.when(F.col("rev") == base_rev, F.col(metric))).alias("base"))
    return out.withColumn("trend", F.when(F.col("base") != 0, F.try_divide(F.col("slope"), F.abs("base"))))


def winner(cells: DataFrame, metric: str, key: str = "key") -> DataFrame:
    """The revision with the worst value (ties: the lowest)."""
    sign = -1 if metric in COMPRESSIVE else 1
    order = F.when(F.col(metric).isNotNull(), F.struct(F.col(metric) * sign, -F.col("rev")))
    return cells.groupBy(key).agg(F.max_by("rev", order).alias("worst_rev"), F.max_by(metric, order).alias("worst"))


def gate(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of cells that aren't trusted become NULL."""
    return cells.withColumns({m: F.when(F.col("trust_ok"), F.col(m)) for m in metrics})


def rank_parts(part_cells: DataFrame, metric: str, base_rev: int) -> DataFrame:
    """Parts of each revision by their worst value, and the change of rank from the base."""
    worst = part_cells.groupBy("rev", "part_name").agg(F.max(metric).alias("worst")).where("worst is not null")
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy("rev").orderBy(F.desc("worst"), "part_name")))
    base = ranked.where(F.col("rev") == base_rev).select("part_name", F.col("rank").alias("base_rank"))
    return ranked.join(base, "part_name", "left").withColumn("rank_delta", F.col("rank") - F.col("base_rank"))


def transitions(cells: DataFrame, base_rev: int, key: str = "key") -> DataFrame:
    """How many cells went from one behaviour in the base to another in each revision."""
    base = cells.where(F.col("rev") == base_rev).select(key, F.col("behavior").alias("from_behavior"))
    return cells.where(F.col("rev") != base_rev).join(base, key).groupBy("rev", "from_behavior", F.col("behavior").alias("to_behavior")).count()


def category_summary(cells: DataFrame, metric: str, base_rev: int) -> DataFrame:
    """Worst, exact median and mean of each category and revision, with the change of the worst from the base."""
    out = cells.groupBy("category", "rev").agg(F.max(metric).alias("worst"), F.percentile(metric, 0.5).alias("median"), F.avg(metric).alias("mean"))
    base = F.max(F.when(F.col("rev") == base_rev, F.col("worst"))).over(Window.partitionBy("category"))
    return out.withColumn("worst_delta_pct", F.when(base != 0, F.try_divide(F.col("worst") - base, F.abs(base)) * 100))


def matrix(cells: DataFrame, row: str, column: str, metric: str, columns: list | None = None) -> DataFrame:
    return cells.groupBy(row).pivot(column, columns).agg(F.max(metric))


def masked(title: Column) -> Column:
    """A finding's title with its numbers masked."""
    return F.trim(F.regexp_replace(F.lower(title), r"[-+]?\d+(?:\.\d+)?", "#"))


def findings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """change and title: new, resolved, changed (other numbers or severity) and kept findings, matched by masked titles.

    Findings of one mask are matched in order of title: first with first, and so on.
    """
    w = Window.partitionBy("__k").orderBy("title", "severity")
    shape = lambda f, p: f.select(masked(F.col("title")).alias("__k"), "title", "severity").distinct().withColumn("__i", F.row_number().over(w)).withColumnsRenamed({"title": f"{p}_title", "severity": f"{p}_severity"})
    both = shape(old, "old").join(shape(new, "new"), ["__k", "__i"], "full")
    change = F.when(F.col("old_title").isNull(), "new").when(F.col("new_title").isNull(), "resolved").when((F.col("old_title") != F.col("new_title")) | ~F.col("old_severity").eqNullSafe(F.col("new_severity")), "changed").otherwise("kept")
    return both.select(change.alias("change"), F.coalesce("new_title", "old_title").alias("title"))


def common_keys(cells: DataFrame, key: str = "key") -> DataFrame:
    """Keys that every revision has."""
    total = cells.agg(F.count_distinct("rev").alias("__n"))
    return cells.groupBy(key).agg(F.count_distinct("rev").alias("__m")).crossJoin(F.broadcast(total)).where("__m = __n").select(key)


def kpis(raw: DataFrame, aligned: DataFrame, metric: str, base_rev: int) -> DataFrame:
    """Of each revision: peak before resampling, its change from the base, and the comparable share of cells."""
    peak = raw.groupBy("rev").agg(F.max(metric).alias("true_peak"), F.count("*").alias("cells"))
    there = aligned.where(F.col(metric).isNotNull()).groupBy("rev").agg(F.count("*").alias("comparable"))
    base = peak.where(F.col("rev") == base_rev).select(F.col("true_peak").alias("__b"))
    out = peak.join(there, "rev", "left").crossJoin(F.broadcast(base))
    return out.select("rev", "true_peak", F.when(F.col("__b") != 0, F.try_divide(F.col("true_peak") - F.col("__b"), F.abs("__b")) * 100).alias("peak_delta_pct"), (F.coalesce("comparable", F.lit(0)) * 100.0 / F.col("cells")).alias("comparable_pct"))


def peak_damping(raw: DataFrame, aligned: DataFrame, metric: str) -> DataFrame:
    """Of each revision: the peak before resampling, the largest resampled value, and by how much percent of the peak that is off; NULL without either, or with a peak of 0."""
    peak = raw.groupBy("rev").agg(F.max(metric).alias("true_peak"))
    other = aligned.groupBy("rev").agg(F.max(metric).alias("resampled_peak"))
    off = F.when(F.col("true_peak") != 0, F.try_divide(F.col("resampled_peak") - F.col("true_peak"), F.abs("true_peak")) * 100)
    return peak.join(other, "rev", "left").withColumn("peak_damping_pct", off)


def drop_small(cells: DataFrame, value: str, share: float = 0.01, least: float = 0.3) -> DataFrame:
    """Without values up to a share of the largest, if that many of all would go."""
    top = cells.agg(F.max(F.abs(value)).alias("__m"))
    marked = cells.crossJoin(F.broadcast(top)).withColumn("__s", F.abs(value) <= share * F.col("__m"))
    rate = marked.agg(F.avg(F.col("__s").cast("double")).alias("__r"))
    return marked.crossJoin(F.broadcast(rate)).where(~((F.col("__r") >= least) & F.coalesce("__s", F.lit(False)))).drop("__m", "__s", "__r")


def significant(c: Column, digits: int = 4) -> Column:
    """Rounded to significant figures."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.try_divide(F.round(c * scale), scale))


def tiers(cells: DataFrame, priority: str, total: int, quotas: tuple[float, float, float] = (0.6, 0.2, 0.2), tier: str = "tier") -> DataFrame:
    """A sample of ``total`` rows by quota of three tiers, the first of each by priority; a feature of reports."""
    w = Window.partitionBy(tier).orderBy(F.desc(priority), "key")
    limit = F.element_at(F.array(*(F.lit(int(total * q)) for q in quotas)), F.col(tier) + 1)
    return cells.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def band(cells: DataFrame, metric: str) -> DataFrame:
    """min, median and max of the rows that a tier plan left."""
    return cells.groupBy("rev").agg(F.min(metric).alias("min"), F.percentile(metric, 0.5).alias("median"), F.max(metric).alias("max"), F.count(metric).alias("n"))


def direction_class(x: Column, y: Column, z: Column) -> Column:
    """face, edge or corner: the nearest of the 26 directions of a cube's faces, edges and corners."""
    a = F.array_sort(F.array(F.abs(x), F.abs(y), F.abs(z)))
    face, edge, corner = F.get(a, F.lit(2)), (F.get(a, F.lit(2)) + F.get(a, F.lit(1))) / 2**0.5, (F.get(a, F.lit(0)) + F.get(a, F.lit(1)) + F.get(a, F.lit(2))) / 3**0.5
    return F.when((face >= edge) & (face >= corner), "face").when(edge >= corner, "edge").otherwise("corner")


#: Factors to SI by unit label.
UNITS = {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "in": 0.0254, "Pa": 1.0, "kPa": 1e3, "MPa": 1e6, "GPa": 1e9, "G": 9.80665, "m/s2": 1.0, "ms": 1e-3, "s": 1.0, "J": 1.0, "mJ": 1e-3}


def convert(c: Column, source: Column, target: str) -> Column:
    """To a unit; NULL where the source's label is unknown."""
    table = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))
    return c * table[source] / UNITS[target]


def guards(cells: DataFrame) -> DataFrame:
    """Input faults: duplicate keys in a revision, and negative magnitudes."""
    twice = cells.groupBy("rev", "key").count().where("count > 1").select("rev", "key", F.lit("duplicate").alias("fault"))
    return twice.union(cells.where("g < 0").select("rev", "key", F.lit("negative").alias("fault")))


def order_faults(cells: DataFrame, larger: str, smaller: str) -> DataFrame:
    """Cells whose metrics are in the wrong order, such as a first principal stress under the third."""
    return cells.where(F.col(larger) < F.col(smaller)).select("rev", "key", F.lit("order").alias("fault"))

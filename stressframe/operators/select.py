"""Selectors: parts, states, quantities, values and regions.

Each selector is a small expression that becomes a Column or a join; ``&``, ``|`` and ``~``
combine them, and nothing is read before an action. A selector that matches nothing selects
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tensor as T
from .quantile import order_statistics


@dataclass(frozen=True)
class Predicate:
    """A condition on the rows of a table."""

    column: Column

    def __and__(self, o: Predicate) -> Predicate:
        return Predicate(self.column & o.column)

    def __or__(self, o: Predicate) -> Predicate:
        return Predicate(self.column | o.column)

    def __invert__(self) -> Predicate:
        return Predicate(~self.column)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column)

    def count(self, df: DataFrame) -> int:
        return self.apply(df).count()

    def has_matches(self, df: DataFrame) -> bool:
        return not self.apply(df).isEmpty()

    def rate(self) -> Column:
        """Share of rows that pass, as an aggregate."""
        return F.avg(F.coalesce(self.column, F.lit(False)).cast("double"))


def glob_to_regex(pattern: str, ignore_case: bool = False) -> str:
    """A whole-string regular expression for a glob of * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return ("(?i)" if ignore_case else "") + f"^(?:{body})$"


class Parts:
    """Predicates on a parts table: part_id, name, material_id, and geometry if it has any."""

    @staticmethod
    def by_id(*ids: int) -> Predicate:
        return Predicate(F.col("part_id").isin(list(ids)))

    @staticmethod
    def by_name(*names: str) -> Predicate:
        return Predicate(F.col("name").isin(list(names)))

    @staticmethod
    def by_glob(pattern: str, ignore_case: bool = False) -> Predicate:
        return Predicate(F.col("name").rlike(glob_to_regex(pattern, ignore_case)))

    @staticmethod
    def by_regex(pattern: str) -> Predicate:
        """Whole-string match; an invalid pattern matches nothing."""
        try:
            re.compile(pattern)
        except re.error:
            return Parts.none()
        return Predicate(F.col("name").rlike(f"^(?:{pattern})$"))

    @staticmethod
    def by_keyword(*words: str) -> Predicate:
        """Names that hold any of the words, whatever the case."""
        return Predicate(reduce(lambda a, b: a | b, (F.lower("name").contains(w.lower()) for w in words), F.lit(False)))

    @staticmethod
    def by_material(*ids: int) -> Predicate:
        return Predicate(F.col("material_id").isin(list(ids)))

    @staticmethod
    def by_property(name: str, low: float | None = None, high: float | None = None) -> Predicate:
        """A property within bounds, which are inclusive; NULL never matches."""
        c = F.col(name).isNotNull()
        c = c if low is None else c & (F.col(name) >= low)
        return Predicate(c if high is None else c & (F.col(name) <= high))

    @staticmethod
    def all() -> Predicate:
        return Predicate(F.lit(True))

    @staticmethod
    def none() -> Predicate:
        return Predicate(F.lit(False))


def default_names(part_ids: DataFrame) -> DataFrame:
    """A parts table with the names that unnamed parts go by."""
    return part_ids.select("part_id").distinct().withColumn("name", F.concat(F.lit("Part_"), F.col("part_id").cast("string")))


class States:
    """Selections of states: each is a function from the states table (state_idx, time) to the chosen ones; ``any_of`` is their union, ``count`` and ``has_matches`` ask how many there are."""

    Choice = Callable[[DataFrame], DataFrame]

    @staticmethod
    def _numbered(states: DataFrame) -> DataFrame:
        total = states.agg(F.count("*").alias("__n"), F.max("state_idx").alias("__last"))
        return states.crossJoin(F.broadcast(total))  # one row

    @staticmethod
    def steps(*steps: int) -> Choice:
        """By index; negative ones count from the end."""
        return lambda s: States._numbered(s).where(reduce(lambda a, b: a | b, (F.col("state_idx") == (F.lit(i) if i >= 0 else F.col("__last") + 1 + i) for i in steps), F.lit(False))).select(*s.columns)

    @staticmethod
    def nearest(*times: float) -> Choice:
        """The state nearest to each time; ties go to the first."""

        def choose(s: DataFrame) -> DataFrame:
            best = s.agg(*(F.min_by("state_idx", F.struct(F.abs(F.col("time") - t), "state_idx")).alias(f"t{i}") for i, t in enumerate(times)))
            wanted = best.select(F.explode(F.array(*best.columns)).alias("__w")).distinct()
            return s.join(F.broadcast(wanted), F.col("state_idx") == F.col("__w"), "left_semi")  # a row for each time asked

        return choose

    @staticmethod
    def between(low: float, high: float, step: float | None = None) -> Choice:
        """Times within bounds, inclusive; with a step, the nearest state to each."""
        if step is None:
            return lambda s: s.where(F.col("time").between(low, high))
        return States.nearest(*(low + i * step for i in range(int((high - low) / step + 1e-9) + 1)))

    @staticmethod
    def index_range(first: int, last: int, stride: int = 1) -> Choice:
        """Indexes from first to last, negative from the end, clamped."""

        def choose(s: DataFrame) -> DataFrame:
            n = F.col("__last") + 1
            a, b = ((F.lit(i) if i >= 0 else n + i) for i in (first, last))
            a = F.greatest(a, F.lit(0))
            return States._numbered(s).where(F.col("state_idx").between(a, F.least(b, F.col("__last"))) & ((F.col("state_idx") - a) % stride == 0)).select(*s.columns)

        return choose

    @staticmethod
    def first(n: int = 1) -> Choice:
        return States.index_range(0, n - 1)

    @staticmethod
    def last(n: int = 1) -> Choice:
        return States.index_range(-n, -1)

    @staticmethod
    def every(n: int) -> Choice:
        return lambda s: s.where(F.col("state_idx") % n == 0)

    @staticmethod
    def all() -> Choice:
        return lambda s: s

    @staticmethod
    def at_extreme(data: DataFrame, quantity: str, largest: bool = True) -> Choice:
        """The state where a quantity is largest or least (ties: the first)."""
        sign = -1 if largest else 1
        best = data.where(F.col(quantity).isNotNull()).agg(F.min_by("state_idx", F.struct(F.col(quantity) * sign, F.col("state_idx"))).alias("__w"))
        return lambda s: s.join(F.broadcast(best), F.col("state_idx") == F.col("__w"), "left_semi")

    @staticmethod
    def exceeding(data: DataFrame, quantity: str, limit: float) -> Choice:
        """States where any row's quantity is above a limit."""
        hit = data.where(F.col(quantity) > limit).select(F.col("state_idx").alias("__w")).distinct()
        return lambda s: s.join(hit, F.col("state_idx") == F.col("__w"), "left_semi")

    @staticmethod
    def times(choice: Choice, states: DataFrame) -> DataFrame:
        """The chosen states' times, in order."""
        return choice(states).select("time").distinct().orderBy("time")

    @staticmethod
    def count(choice: Choice, states: DataFrame) -> int:
        return choice(states).count()

    @staticmethod
    def has_matches(choice: Choice, states: DataFrame) -> bool:
        return not choice(states).isEmpty()

    @staticmethod
    def any_of(*choices: Choice) -> Choice:
        return lambda s: reduce(DataFrame.union, (c(s) for c in choices)).distinct()


#: Quantities by name: a builder of the Column.
QUANTITIES: dict[str, Callable[[], Column]] = {
    "x_stress": lambda: F.col("sxx"), "y_stress": lambda: F.col("syy"), "z_stress": lambda: F.col("szz"),
    "xy_stress": lambda: F.col("txy"), "yz_stress": lambda: F.col("tyz"), "zx_stress": lambda: F.col("tzx"),
    "von_mises": lambda: T.stress().von_mises(), "signed_von_mises": lambda: T.stress().signed_von_mises(),
    "pressure": lambda: T.stress().pressure(), "max_shear": lambda: T.stress().max_shear(),
    "principal_1": lambda: T.stress().principals()[0], "principal_2": lambda: T.stress().principals()[1], "principal_3": lambda: T.stress().principals()[2],
    "effective_plastic_strain": lambda: F.col("eps"),
    "x_strain": lambda: F.col("exx"), "y_strain": lambda: F.col("eyy"), "z_strain": lambda: F.col("ezz"),
    "xy_strain": lambda: F.col("exy"), "yz_strain": lambda: F.col("eyz"), "zx_strain": lambda: F.col("ezx"),
    "strain_principal_1": lambda: T.strain().principals()[0], "strain_principal_3": lambda: T.strain().principals()[2], "effective_strain": lambda: T.strain().strain_von_mises(),
    "x_displacement": lambda: F.col("x") - F.col("x0"), "y_displacement": lambda: F.col("y") - F.col("y0"), "z_displacement": lambda: F.col("z") - F.col("z0"),
    "displacement": lambda: (T.vector("") - T.vector("", ("x0", "y0", "z0"))).length(),
    "x_velocity": lambda: F.col("vx"), "y_velocity": lambda: F.col("vy"), "z_velocity": lambda: F.col("vz"), "velocity": lambda: T.vector("v").length(),
    "x_acceleration": lambda: F.col("ax"), "y_acceleration": lambda: F.col("ay"), "z_acceleration": lambda: F.col("az"), "acceleration": lambda: T.vector("a").length(),
}
ALIASES = {"vm": "von_mises", "mises": "von_mises", "plastic_strain": "effective_plastic_strain", "eps": "effective_plastic_strain", "s1": "principal_1", "s2": "principal_2", "s3": "principal_3", "e1": "strain_principal_1", "e3": "strain_principal_3", "disp": "displacement", "vel": "velocity", "acc": "acceleration"}
GROUPS = {
    "stress": [q for q in QUANTITIES if "stress" in q or q in ("von_mises", "pressure", "max_shear", "principal_1", "principal_2", "principal_3")],
    "strain": [q for q in QUANTITIES if "strain" in q],
    "displacement": [q for q in QUANTITIES if "displacement" in q],
    "motion": [q for q in QUANTITIES if "velocity" in q or "acceleration" in q],
    "common": ["von_mises", "effective_plastic_strain", "pressure", "max_shear"],
    "all": list(QUANTITIES),
}


class Quantities:
    """An ordered set of quantities."""

    def __init__(self, names: Iterable[str] = ()) -> None:
        self.names: list[str] = []
        self.add(*names)

    def add(self, *names: str) -> Quantities:
        """Names, aliases or groups."""
        for name in names:
            for q in GROUPS.get(name, [ALIASES.get(name.lower(), name.lower())]):
                if q not in QUANTITIES:
                    raise KeyError(f"no quantity {name!r}")
                if q not in self.names:
                    self.names.append(q)
        return self

    def remove(self, *names: str) -> Quantities:
        gone = {q for n in names for q in GROUPS.get(n, [ALIASES.get(n.lower(), n.lower())])}
        self.names = [q for q in self.names if q not in gone]
        return self

    def clear(self) -> Quantities:
        self.names = []
        return self

    def __contains__(self, name: str) -> bool:
        return ALIASES.get(name.lower(), name.lower()) in self.names

    def columns(self) -> list[Column]:
        return [QUANTITIES[q]().alias(q) for q in self.names]


class Values:
    """Filters on one column. The statistical ones take their thresholds once, from all rows: means as a broadcast row, percentiles by a few aggregations that run at once."""

    @staticmethod
    def _statistic(df: DataFrame, test: Callable[[Column], Column], *aggregates: Column) -> DataFrame:
        limits = df.agg(F.struct(*(a.alias(f"a{i}") for i, a in enumerate(aggregates))).alias("__s"))
        return df.crossJoin(F.broadcast(limits)).where(test(F.col("__s"))).drop("__s")  # one row

    @staticmethod
    def in_range(c: str, low: float, high: float) -> Predicate:
        return Predicate(F.col(c).between(low, high))

    @staticmethod
    def outside_range(c: str, low: float, high: float) -> Predicate:
        return Predicate((F.col(c) < low) | (F.col(c) > high))

    @staticmethod
    def compare(c: str, sign: str, v: float, tolerance: float = 1e-9) -> Predicate:
        """sign: > >= < <= == !=; the last two within a tolerance."""
        x = F.col(c)
        return Predicate({">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "==": F.abs(x - v) < tolerance, "!=": F.abs(x - v) >= tolerance}[sign])

    @staticmethod
    def positive(c: str) -> Predicate:
        return Predicate(F.col(c) > 0)

    @staticmethod
    def negative(c: str) -> Predicate:
        return Predicate(F.col(c) < 0)

    @staticmethod
    def non_zero(c: str, tolerance: float = 1e-9) -> Predicate:
        return Values.compare(c, "!=", 0.0, tolerance)

    @staticmethod
    def custom(make: Callable[..., Column], *columns: str) -> Predicate:
        return Predicate(make(*map(F.col, columns)))

    @staticmethod
    def any_quantity(columns: Iterable[str], make: Callable[[str], Predicate]) -> Predicate:
        """Rows of which any of the columns passes."""
        return Predicate(reduce(lambda a, b: a | b, (F.coalesce(make(c).column, F.lit(False)) for c in columns)))

    @staticmethod
    def _percentiles(df: DataFrame, c: str, *percents: float) -> list[Column]:
        """Exact percentiles, found at once by a few aggregations; NULL without values."""
        return [F.lit(v).cast("double") for v in order_statistics(df, c, [p / 100 for p in percents])]

    @staticmethod
    def top_percent(df: DataFrame, c: str, p: float) -> DataFrame:
        return df.where(F.col(c) >= Values._percentiles(df, c, 100 - p)[0])

    @staticmethod
    def bottom_percent(df: DataFrame, c: str, p: float) -> DataFrame:
        return df.where(F.col(c) <= Values._percentiles(df, c, p)[0])

    @staticmethod
    def between_percentiles(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
        return df.where(F.col(c).between(*Values._percentiles(df, c, low, high)))

    @staticmethod
    def without_outliers(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
        """Within k interquartile ranges of the quartiles."""
        q1, q3 = Values._percentiles(df, c, 25, 75)
        return df.where(F.col(c).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)))

    @staticmethod
    def accept_all() -> Predicate:
        return Predicate(F.lit(True))

    @staticmethod
    def reject_all() -> Predicate:
        return Predicate(F.lit(False))

    @staticmethod
    def within_sigma(df: DataFrame, c: str, n: float, inside: bool = True) -> DataFrame:
        """By population standard deviations from the mean."""
        near = lambda s: F.abs(F.col(c) - s["a0"]) <= n * s["a1"]
        return Values._statistic(df, near if inside else lambda s: ~near(s), F.avg(c), F.stddev_pop(c))

    @staticmethod
    def extreme_n(df: DataFrame, c: str, n: int, largest: bool = True) -> DataFrame:
        """The n largest or least, with all that tie with the last; none for n of 0 or less.

        The threshold is found by a bounded top-n, not by a rank over all rows.
        """
        if n <= 0:
            return df.limit(0)
        order = F.desc(c) if largest else F.asc(c)
        edge = df.where(F.col(c).isNotNull()).select(c).orderBy(order).limit(n).agg((F.min if largest else F.max)(c).alias("__e"))
        return df.crossJoin(F.broadcast(edge)).where(F.col(c) >= F.col("__e") if largest else F.col(c) <= F.col("__e")).drop("__e")


class Regions:
    """Predicates on points x, y, z."""

    P = staticmethod(lambda: T.vector(""))

    @staticmethod
    def _at(p: tuple[float, float, float]) -> T.Vector:
        return T.Vector(*(F.lit(float(v)) for v in p))

    @staticmethod
    def box(low: tuple[float, float, float], high: tuple[float, float, float]) -> Predicate:
        return Predicate(reduce(lambda a, b: a & b, (F.col(c).between(a, b) for c, a, b in zip("xyz", low, high, strict=True))))

    @staticmethod
    def sphere(centre: tuple[float, float, float], radius: float) -> Predicate:
        d = T.vector("") - Regions._at(centre)
        return Predicate(d.dot(d) <= radius * radius)

    @staticmethod
    def cylinder(base: tuple[float, float, float], axis: tuple[float, float, float], radius: float, height: float) -> Predicate:
        n = sum(a * a for a in axis) ** 0.5
        u, d = Regions._at(tuple(a / n for a in axis)), T.vector("") - Regions._at(base)
        along = d.dot(u)
        return Predicate((along >= 0) & (along <= height) & (d.dot(d) - along * along <= radius * radius))

    @staticmethod
    def _signed(point: tuple[float, float, float], normal: tuple[float, float, float]) -> Column:
        n = sum(a * a for a in normal) ** 0.5
        return (T.vector("") - Regions._at(point)).dot(Regions._at(tuple(a / n for a in normal)))

    @staticmethod
    def plane(point: tuple[float, float, float], normal: tuple[float, float, float], tolerance: float) -> Predicate:
        return Predicate(F.abs(Regions._signed(point, normal)) <= tolerance)

    @staticmethod
    def half_space(point: tuple[float, float, float], normal: tuple[float, float, float]) -> Predicate:
        return Predicate(Regions._signed(point, normal) >= 0)

    @staticmethod
    def coordinate_plane(axis: str, at: float, tolerance: float) -> Predicate:
        return Predicate(F.abs(F.col(axis) - at) <= tolerance)

    @staticmethod
    def none() -> Predicate:
        return Predicate(F.lit(False))


def by_parts(df: DataFrame, parts: DataFrame, chosen: Predicate) -> DataFrame:
    """Rows whose part is chosen from the parts table."""
    return df.join(chosen.apply(parts).select("part_id").distinct(), "part_id", "left_semi")


def not_parts(df: DataFrame, parts: DataFrame, chosen: Predicate) -> DataFrame:
    return df.join(chosen.apply(parts).select("part_id").distinct(), "part_id", "left_anti")

"""Queries of selectors, tensor functions, results and part statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, tensor
from ..operators import parts as P
from ..operators import results as R
from ..operators.select import QUANTITIES, Parts, Regions, States, Values, by_parts, default_names, not_parts
from . import tables as T
from .registry import near, query, rounded


def _vm(s: SparkSession, d: str) -> DataFrame:
    """Element states with their von Mises stress."""
    return T.element_states(s, d).withColumn("von_mises", QUANTITIES["von_mises"]())


VMT = f"{T.ES}, vm AS (SELECT *, {T.VM} AS von_mises FROM es)"
KEY = "row_id, row_line, part_id, element_id"


def _rows(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select("row_id", "row_line", "part_id", "element_id", *more))


@query(f"""WITH {VMT} SELECT part_id, state_idx, min(time) AS time, round(max(von_mises), 6) AS von_mises_max, round(min(von_mises), 6) AS von_mises_min, round(avg(von_mises), 6) AS von_mises_avg,
  round(sqrt(avg(von_mises * von_mises)), 6) AS von_mises_rms, arg_max(element_id, (round(von_mises, 9), -element_id)) AS von_mises_max_element, arg_min(element_id, (round(von_mises, 9), element_id)) AS von_mises_min_element FROM vm GROUP BY 1, 2""")
def part_state_von_mises(s, d):
    out = P.part_state_statistics(T.element_states(s, d), ["von_mises"], ties=9)
    return rounded(out)


@query(f"""WITH {VMT}, q AS (SELECT *, {T.PRESSURE} AS pressure FROM vm) SELECT part_id, state_idx, min(time) AS time,
  round(max(pressure), 6) AS pressure_max, round(min(pressure), 6) AS pressure_min, round(avg(pressure), 6) AS pressure_avg, round(sqrt(avg(pressure * pressure)), 6) AS pressure_rms,
  round(max(eps), 6) AS eps_max, round(min(eps), 6) AS eps_min, round(avg(eps), 6) AS eps_avg, round(sqrt(avg(eps * eps)), 6) AS eps_rms FROM q GROUP BY 1, 2""")
def single_pass_statistics(s, d):
    out = P.part_state_statistics(T.element_states(s, d), ["pressure", "effective_plastic_strain"])
    return rounded(out.select("part_id", "state_idx", "time", *(f"pressure_{k}" for k in ("max", "min", "avg", "rms")), *(F.col(f"effective_plastic_strain_{k}").alias(f"eps_{k}") for k in ("max", "min", "avg", "rms"))))


@query(f"""WITH {T.ES} SELECT {KEY}, round({T.VM}, 6) AS von_mises, round({T.PRESSURE}, 6) AS pressure, round(sxx + syy + szz, 6) AS i1,
  round(sxx*syy + syy*szz + szz*sxx - txy*txy - tyz*tyz - tzx*tzx, 6) AS i2, round(sxx*syy*szz + 2*txy*tyz*tzx - sxx*tyz*tyz - syy*tzx*tzx - szz*txy*txy, 4) AS i3,
  round(CASE WHEN sxx + syy + szz < 0 THEN -1 ELSE 1 END * {T.VM}, 6) AS signed_von_mises FROM es""")
def tensor_invariants(s, d):
    t = tensor.stress()
    return _rows(T.element_states(s, d).select("*", t.von_mises().alias("von_mises"), t.pressure().alias("pressure"), t.i1().alias("i1"), t.i2().alias("i2"), near(t.i3(), 4).alias("i3"), t.signed_von_mises().alias("signed_von_mises")), "von_mises", "pressure", "i1", "i2", "i3", "signed_von_mises")


@query(f"""WITH {T.ES}, j AS (SELECT *, (sxx+syy+szz)/3 AS m, (({T.VM})*({T.VM}))/3 AS j2 FROM es),
  k AS (SELECT *, ((sxx-m)*(syy-m)*(szz-m) + 2*txy*tyz*tzx - (sxx-m)*tyz*tyz - (syy-m)*tzx*tzx - (szz-m)*txy*txy) AS j3 FROM j),
  a AS (SELECT *, acos(greatest(least(j3 * 1.5 * sqrt(3) / pow(j2, 1.5), 1), -1)) / 3 AS th, 2 * sqrt(j2 / 3) AS r FROM k)
  SELECT {KEY}, round(m + r * cos(th), 4) AS s1, round(m + r * cos(th - 2 * pi() / 3), 4) AS s2, round(m + r * cos(th + 2 * pi() / 3), 4) AS s3, round((r * cos(th) - r * cos(th + 2 * pi() / 3)) / 2, 4) AS max_shear FROM a""")
def tensor_principals(s, d):
    s1, s2, s3 = tensor.stress().principals()
    return rounded(T.element_states(s, d).select("row_id", "row_line", "part_id", "element_id", s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), ((s1 - s3) / 2).alias("max_shear")), 4)


@query(f"""WITH {T.ES}, t AS (SELECT *, (sxx*0.6 + txy*0.8) AS tx, (txy*0.6 + syy*0.8) AS ty, (tzx*0.6 + tyz*0.8) AS tz FROM es)
  SELECT {KEY}, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz, round(tx*0.6 + ty*0.8, 6) AS normal, round(sqrt(greatest(tx*tx + ty*ty + tz*tz - (tx*0.6 + ty*0.8)*(tx*0.6 + ty*0.8), 0)), 4) AS shear FROM t""")
def traction_on_plane(s, d):
    n = tensor.Vector(F.lit(0.6), F.lit(0.8), F.lit(0.0))
    t = tensor.stress().traction(n)
    return _rows(T.element_states(s, d).select("*", t.x.alias("tx"), t.y.alias("ty"), t.z.alias("tz"), tensor.stress().normal(n).alias("normal"), near(tensor.stress().shear(n), 4).alias("shear")), "tx", "ty", "tz", "normal", "shear")


@query(f"""WITH {T.ES} SELECT {KEY}, round(0.36*sxx + 0.64*syy + 0.96*txy, 6) AS rxx, round(0.64*sxx + 0.36*syy - 0.96*txy, 6) AS ryy, round(szz, 6) AS rzz, round(-0.48*sxx + 0.48*syy + (0.36-0.64)*txy, 6) AS rxy FROM es""")
def tensor_rotation(s, d):
    v = lambda *a: tensor.Vector(*map(F.lit, a))
    r = tensor.stress().rotate(v(0.6, 0.8, 0.0), v(-0.8, 0.6, 0.0), v(0.0, 0.0, 1.0))
    return _rows(T.element_states(s, d).select("*", r.xx.alias("rxx"), r.yy.alias("ryy"), r.zz.alias("rzz"), r.xy.alias("rxy")), "rxx", "ryy", "rzz", "rxy")


@query(f"""WITH {T.POINTS} SELECT point_id, round(sqrt(x*x + y*y + z*z), 6) AS length, round(x*1 + y*2 + z*3, 6) AS dot, round(y*3 - z*2, 6) AS cx, round(z*1 - x*3, 6) AS cy, round(x*2 - y*1, 6) AS cz,
  round(CASE WHEN sqrt(x*x + y*y + z*z) > 1e-12 THEN degrees(acos(greatest(least((x + 2*y + 3*z) / (sqrt(x*x + y*y + z*z) * sqrt(14)), 1), -1))) END, 4) AS angle FROM pts""")
def vector_functions(s, d):
    p, o = tensor.vector(""), tensor.Vector(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    c = p.cross(o)
    return rounded(T.points(s, d).select("point_id", p.length().alias("length"), p.dot(o).alias("dot"), c.x.alias("cx"), c.y.alias("cy"), c.z.alias("cz"), near(p.angle(o), 4).alias("angle")))


# Part selection

@query(f"WITH {VMT} SELECT {KEY}, round(von_mises, 6) AS von_mises FROM vm WHERE part_id IN (1, 3, 7)")
def select_parts_by_id(s, d):
    return _rows(_vm(s, d).where(Parts.by_id(1, 3, 7).column), "von_mises")


@query(f"WITH {T.ES} SELECT part_id, 'Part_' || part_id AS name FROM es WHERE 'Part_' || part_id IN ('Part_2', 'Part_5') GROUP BY part_id")
def select_parts_by_name(s, d):
    return Parts.by_name("Part_2", "Part_5").apply(default_names(T.element_states(s, d)))


@query(f"WITH {T.PARTS} SELECT part_id, name FROM parts WHERE brand LIKE 'Brand#1%' AND regexp_full_match(lower(name), '.*e.*')")
def select_parts_by_glob(s, d):
    from ..operators.select import glob_to_regex

    return T.part_table(s, d).where(F.col("brand").rlike(glob_to_regex("Brand#1*")) & Parts.by_glob("*E*", True).column).select("part_id", "name")


@query(f"WITH {T.PARTS} SELECT part_id, name FROM parts WHERE regexp_full_match(name, '[a-m].*|.*[0-9]')")
def select_parts_by_regex(s, d):
    return Parts.by_regex("[a-m].*|.*[0-9]").apply(T.part_table(s, d)).select("part_id", "name")


@query(f"WITH {T.PARTS} SELECT part_id, material_id, round(mass, 6) AS mass FROM parts WHERE material_id IN (1, 5, 9) AND mass BETWEEN 10 AND 1800")
def select_parts_by_material_and_property(s, d):
    return rounded((Parts.by_material(1, 5, 9) & Parts.by_property("mass", 10, 1800)).apply(T.part_table(s, d)).select("part_id", "material_id", "mass"))


@query(f"WITH {T.PARTS} SELECT part_id FROM parts WHERE NOT (material_id IN (1, 5) OR lower(name) LIKE '%a%')")
def select_parts_not_or(s, d):
    return (~(Parts.by_material(1, 5) | Parts.by_keyword("A"))).apply(T.part_table(s, d)).select("part_id")


@query(f"WITH {VMT}, {T.PARTS} SELECT {KEY}, round(von_mises, 6) AS von_mises FROM vm WHERE part_id IN (SELECT part_id FROM parts WHERE material_id <= 10)")
def semi_join_selected_parts(s, d):
    return _rows(by_parts(_vm(s, d), T.part_table(s, d), Parts.by_property("material_id", None, 10)), "von_mises")


@query(f"WITH {T.ES}, {T.PARTS} SELECT {KEY}, round(sxx, 6) AS sxx FROM es WHERE part_id NOT IN (SELECT part_id FROM parts WHERE material_id <= 45)")
def anti_join_parts(s, d):
    return _rows(not_parts(T.element_states(s, d), T.part_table(s, d), Parts.by_property("material_id", None, 45)), "sxx")


# State selection

def _states(s, d, choice):
    return choice(T.states(s, d)).select("state_idx")


BASE = f"WITH {T.ES}, {T.STATES}, n AS (SELECT max(state_idx) AS last FROM st) SELECT state_idx FROM st, n WHERE "


@query(BASE + "state_idx IN (0, 3, last, last - 2)")
def states_by_step(s, d):
    return _states(s, d, States.steps(0, 3, -1, -3))


@query(f"WITH {T.ES}, {T.STATES} SELECT DISTINCT w AS state_idx FROM (SELECT arg_min(state_idx, (abs(time - 0.0404), state_idx)) AS w FROM st UNION SELECT arg_min(state_idx, (abs(time - 0.0701), state_idx)) FROM st)")
def states_nearest_time(s, d):
    return _states(s, d, States.nearest(0.0404, 0.0701))


@query(BASE + "time BETWEEN 0.04 AND 0.0601")
def states_in_time_range(s, d):
    return _states(s, d, States.between(0.04, 0.0601))


@query(BASE + "state_idx BETWEEN 5 AND last - 4 AND (state_idx - 5) % 7 = 0")
def states_index_range(s, d):
    return _states(s, d, States.index_range(5, -5, 7))


@query(BASE + "state_idx < 2 OR state_idx > last - 3 OR state_idx % 20 = 0")
def states_union(s, d):
    return _states(s, d, States.any_of(States.first(2), States.last(3), States.every(20)))


@query(f"WITH {VMT} SELECT arg_min(state_idx, (-round(von_mises, 9), state_idx)) AS state_idx FROM vm")
def states_at_largest(s, d):
    data = _vm(s, d).withColumn("von_mises", F.round("von_mises", 9))
    return _states(s, d, States.at_extreme(data, "von_mises"))


@query(f"WITH {VMT} SELECT DISTINCT state_idx FROM vm WHERE von_mises > 108")
def states_exceeding(s, d):
    return _states(s, d, States.exceeding(_vm(s, d), "von_mises", 108))


# Value filters

@query(f"WITH {VMT} SELECT {KEY}, round(von_mises, 6) AS von_mises FROM vm WHERE (von_mises BETWEEN 20 AND 30 OR sxx < 3 OR sxx > 48) AND NOT syy < 10")
def values_ranges(s, d):
    c = (Values.in_range("von_mises", 20, 30) | Values.outside_range("sxx", 3, 48)) & ~Values.compare("syy", "<", 10)
    return _rows(c.apply(_vm(s, d)), "von_mises")


@query(f"WITH {T.ES} SELECT {KEY}, round(sxx, 6) AS sxx FROM es WHERE abs(sxx - 7) < 1e-9 AND abs(txy - 2) >= 1e-9 AND tyz < 0")
def values_equal_tolerance(s, d):
    return _rows((Values.compare("sxx", "==", 7) & Values.compare("txy", "!=", 2) & Values.negative("tyz")).apply(T.element_states(s, d)), "sxx")


def _syy(f):
    return lambda s, d: _rows(f(T.element_states(s, d)), "syy")


STAT = f"WITH {T.ES}, q AS (SELECT quantile_cont(syy, 0.05) AS p5, quantile_cont(syy, 0.25) AS p25, quantile_cont(syy, 0.75) AS p75, quantile_cont(syy, 0.95) AS p95, avg(syy) AS m, stddev_pop(syy) AS sd FROM es) SELECT {KEY}, round(syy, 6) AS syy FROM es, q WHERE "


@query(STAT + "syy >= p95")
def values_top_percent(s, d):
    return _syy(lambda e: Values.top_percent(e, "syy", 5))(s, d)


@query(STAT + "syy <= p5")
def values_bottom_percent(s, d):
    return _syy(lambda e: Values.bottom_percent(e, "syy", 5))(s, d)


@query(STAT + "syy BETWEEN p25 AND p75")
def values_between_percentiles(s, d):
    return _syy(lambda e: Values.between_percentiles(e, "syy", 25, 75))(s, d)


@query(STAT + "syy BETWEEN p25 - 0.5 * (p75 - p25) AND p75 + 0.5 * (p75 - p25)")
def values_without_outliers(s, d):
    return _syy(lambda e: Values.without_outliers(e, "syy", 0.5))(s, d)


@query(STAT + "abs(syy - m) <= 1.3 * sd")
def values_within_sigma(s, d):
    return _syy(lambda e: Values.within_sigma(e, "syy", 1.3))(s, d)


@query(STAT + "abs(syy - m) > 1.3 * sd")
def values_outside_sigma(s, d):
    return _syy(lambda e: Values.within_sigma(e, "syy", 1.3, False))(s, d)


@query(f"WITH {T.ES} SELECT {KEY}, round(sxx, 6) AS sxx FROM (SELECT *, rank() OVER (ORDER BY sxx DESC) AS r FROM es) WHERE r <= 10")
def values_top_n_with_ties(s, d):
    return _rows(Values.extreme_n(T.element_states(s, d), "sxx", 10), "sxx")


@query(f"WITH {T.ES} SELECT {KEY}, round(syy, 6) AS syy FROM (SELECT *, rank() OVER (ORDER BY syy) AS r FROM es) WHERE r <= 15")
def values_bottom_n_with_ties(s, d):
    return _rows(Values.extreme_n(T.element_states(s, d), "syy", 15, False), "syy")


@query(f"WITH {T.ES} SELECT {KEY}, round(sxx, 6) AS sxx FROM es WHERE sxx > 49 OR szz > 9.5 OR txy > 7.5")
def values_any_quantity(s, d):
    limits = {"sxx": 49, "szz": 9.5, "txy": 7.5}
    return _rows(Values.any_quantity(limits, lambda c: Values.compare(c, ">", limits[c])).apply(T.element_states(s, d)), "sxx")


@query(f"WITH {T.ES} SELECT round(avg(CASE WHEN sxx > 25 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) FILTER (WHERE sxx > 25) AS n FROM es")
def values_passing_rate(s, d):
    p = Values.custom(lambda a: a > 25, "sxx")
    return rounded(T.element_states(s, d).agg(p.rate().alias("rate"), F.count_if(p.column).alias("n")))


# Regions

def _region(p, *more):
    return lambda s, d: rounded(p.apply(T.points(s, d)).select("point_id", "x", "y", "z"))


PT = f"WITH {T.POINTS} SELECT point_id, x, y, z FROM pts WHERE "


@query(PT + "x BETWEEN -20 AND 30 AND y BETWEEN -10 AND 25 AND z BETWEEN 2 AND 14")
def region_box(s, d):
    return _region(Regions.box((-20, -10, 2), (30, 25, 14)))(s, d)


@query(PT + "(x-5)*(x-5) + (y+3)*(y+3) + (z-7)*(z-7) <= 625")
def region_sphere(s, d):
    return _region(Regions.sphere((5, -3, 7), 25))(s, d)


@query(PT + "(z - 1) BETWEEN 0 AND 9 AND x*x + y*y <= 900")
def region_cylinder(s, d):
    return _region(Regions.cylinder((0, 0, 1), (0, 0, 2), 30, 9))(s, d)


@query(PT + "NOT (abs(x - 4) <= 10.5) AND 0.6 * x + 0.8 * y >= 2.05")
def region_plane_and_half_space(s, d):
    return _region(~Regions.plane((4, 0, 0), (3, 0, 0), 10.5) & Regions.half_space((0.5 * 4.1 / 0.6, 0, 0), (0.6, 0.8, 0)))(s, d)


# Results

@query(f"""WITH {VMT}, r AS (SELECT part_id, state_idx, time, element_id, round(von_mises, 9) AS v FROM vm) SELECT part_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(sum(v), 4) AS sum, round(max(v) - min(v), 6) AS range,
  round(quantile_cont(v, 0.5), 6) AS median, count(v) AS count, arg_max(element_id, (v, -state_idx, -element_id)) AS max_element, arg_max(state_idx, (v, -state_idx, -element_id)) AS max_state, arg_max(time, (v, -state_idx, -element_id)) AS max_time,
  arg_max(element_id, (-v, -state_idx, -element_id)) AS min_element, arg_max(state_idx, (-v, -state_idx, -element_id)) AS min_state, arg_max(time, (-v, -state_idx, -element_id)) AS min_time FROM r GROUP BY 1""")
def result_statistics(s, d):
    out = R.statistics(_vm(s, d).withColumn("v", F.round("von_mises", 9)), "v", ("part_id",))
    return rounded(out.withColumn("sum", near(F.col("sum"), 4)))


@query(f"""WITH {T.ES}, u AS (SELECT 'sxx' AS quantity, sxx AS v FROM es UNION ALL SELECT 'syy', syy FROM es UNION ALL SELECT 'txy', txy FROM es)
  SELECT quantity, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS count FROM u GROUP BY 1""")
def all_quantities_statistics(s, d):
    e = T.element_states(s, d).select("element_id", "state_idx", "time", "sxx", "syy", "txy")
    return rounded(R.all_statistics(e, ["sxx", "syy", "txy"]).select("quantity", "min", "max", "mean", "sd", "median", "count"))


@query(f"""WITH {T.ES} SELECT element_id, round(max(syy), 6) AS max, round(min(syy), 6) AS min, round(avg(syy), 6) AS mean, round(CASE WHEN count(syy) > 1 THEN stddev_samp(syy) ELSE 0 END, 6) AS sd, round(sum(syy), 4) AS sum, count(syy) AS count, round(max(syy) - min(syy), 6) AS range, round(quantile_cont(syy, 0.5), 6) AS median,
  arg_max(time, (syy, -state_idx, -element_id)) AS time_of_max, arg_max(time, (-syy, -state_idx, -element_id)) AS time_of_min FROM es GROUP BY 1""")
def aggregate_by_element(s, d):
    out = R.by_element(T.element_states(s, d), "syy", tuple(k for k in R.AGGREGATES if k != "last"))
    return rounded(out.withColumn("sum", near(F.col("sum"), 4)))


@query(f"WITH {T.ES} SELECT round(coalesce(quantile_cont(syy, 0.5), 0), 6) AS value FROM es")
def scalar_median(s, d):
    return rounded(R.scalar(T.element_states(s, d), "syy", "median"))


@query(f"WITH {T.ES} SELECT state_idx, round(max(syy), 6) AS max, arg_max(element_id, (syy, -state_idx, -element_id)) AS element_id FROM es GROUP BY 1")
def spatial_maximum(s, d):
    return rounded(R.spatial_max(T.element_states(s, d), "syy"))


@query(f"WITH {T.ES} SELECT element_id, state_idx, round(syy, 6) AS syy FROM es ORDER BY syy DESC, state_idx, element_id LIMIT 1")
def find_largest(s, d):
    return rounded(R.find_extreme(T.element_states(s, d), "syy").select("element_id", "state_idx", "syy"))


@query(f"WITH {T.ES} SELECT element_id, state_idx, round(syy, 6) AS syy FROM es ORDER BY syy, state_idx, element_id LIMIT 20")
def bottom_n_rows(s, d):
    return rounded(R.top_n(T.element_states(s, d), "syy", 20, False).select("element_id", "state_idx", "syy"))


@query(f"WITH {T.ES} SELECT element_id, state_idx, round(sxx, 6) AS value, row_number() OVER (PARTITION BY element_id ORDER BY time, state_idx, sxx) AS i FROM es")
def element_history(s, d):
    h = R.history(T.element_states(s, d), "sxx")
    return rounded(h.select("element_id", F.posexplode("series").alias("p", "s")).select("element_id", "s.state_idx", "s.value", (F.col("p") + 1).alias("i")))


@query(f"WITH {T.ES} SELECT count(DISTINCT part_id) AS parts, count(DISTINCT element_id) AS elements, count(DISTINCT state_idx) AS states FROM es")
def distinct_counts(s, d):
    return T.element_states(s, d).agg(F.count_distinct("part_id").alias("parts"), F.count_distinct("element_id").alias("elements"), F.count_distinct("state_idx").alias("states"))


# Parts

@query(f"""WITH {VMT}, r AS (SELECT *, round(von_mises, 9) AS v FROM vm) SELECT part_id, round(max(v), 6) AS peak, arg_max(element_id, (v, -state_idx, -element_id)) AS element_id, arg_max(state_idx, (v, -state_idx, -element_id)) AS state_idx FROM r GROUP BY 1""")
def peak_element_of_part(s, d):
    return rounded(P.peak_elements(T.element_states(s, d), "von_mises", ties=9))


@query(f"WITH {T.ES}, p AS (SELECT part_id, arg_max(element_id, (syy, -state_idx, -element_id)) AS element_id FROM es GROUP BY 1) SELECT {KEY.replace('part_id, element_id', 'es.part_id, es.element_id')}, round(sxx, 6) AS sxx, round(syy, 6) AS syy FROM es JOIN p ON es.part_id = p.part_id AND es.element_id = p.element_id")
def peak_tensor_history(s, d):
    return _rows(P.peak_tensor_history(T.element_states(s, d), "y_stress"), "sxx", "syy")


@query(f"""WITH {T.ES}, m AS (SELECT part_id, state_idx, min(time) AS time, max(syy) AS mx, min(syy) AS mn FROM es GROUP BY 1, 2)
  SELECT part_id, round(max(mx), 6) AS global_max, round(min(mn), 6) AS global_min, arg_min(time, (-mx, state_idx)) AS time_of_max, arg_min(time, (mn, state_idx)) AS time_of_min FROM m GROUP BY 1""")
def global_extremes_of_series(s, d):
    return rounded(P.global_extremes(P.part_state_statistics(T.element_states(s, d), ["y_stress"]), "y_stress"))


@query(f"""WITH {T.ES}, sets AS (SELECT part_id, part_id % 5 AS set_id FROM (SELECT DISTINCT part_id FROM es)), a AS (SELECT set_id, state_idx, max(syy) AS mx, min(tyz) AS mn FROM es JOIN sets USING (part_id) GROUP BY 1, 2)
  SELECT set_id, 'y_stress' AS field, round(max(mx), 6) AS peak, arg_max(state_idx, (mx, -state_idx)) AS state_idx FROM a GROUP BY 1 UNION ALL SELECT set_id, 'yz_stress', round(min(mn), 6), arg_min(state_idx, (mn, state_idx)) FROM a GROUP BY 1""")
def set_field_peaks(s, d):
    e = T.element_states(s, d)
    sets = e.select("part_id").distinct().withColumn("set_id", F.col("part_id") % 5)
    return rounded(P.set_fields(e, sets, {"y_stress": True, "yz_stress": False}))


@query(f"""WITH {T.PARTS}, w AS (SELECT 3 AS part_id UNION SELECT 99999999 UNION SELECT part_id FROM parts WHERE regexp_full_match(lower(name), 'a.*') UNION SELECT part_id FROM parts WHERE material_id = 7)
  SELECT w.part_id, p.part_id IS NOT NULL AS found FROM w LEFT JOIN parts p ON w.part_id = p.part_id""")
def set_resolution(s, d):
    parts = T.part_table(s, d)
    ids = s.createDataFrame([(3,), (99999999,)], "part_id long")
    return P.resolve_set(parts, ids, ["a.*"], Parts.by_material(7).apply(parts))


@query(f"""WITH {T.ES}, u AS (SELECT part_id, element_id, state_idx, unnest(['axial', 'shear_s', 'shear_t', 'moment_s', 'moment_t', 'torsion']) AS component, unnest([sxx, syy, szz, txy, tyz, tzx]) AS v FROM es)
  SELECT part_id, state_idx, component, round(max(v), 6) AS max, arg_max(element_id, (v, -element_id)) AS max_element, round(min(v), 6) AS min, arg_max(element_id, (-v, -element_id)) AS min_element FROM u GROUP BY 1, 2, 3""")
def beam_resultants(s, d):
    beams = T.element_states(s, d).select("part_id", "element_id", "state_idx", F.array(*tensor.STRESS).alias("words"))
    return rounded(P.beam_resultants(beams))


@query(f"""WITH {T.ES}, g AS (SELECT part_id, state_idx, min(time) AS time, max(syy) AS mx, min(syy) AS mn, avg(syy) AS av FROM es WHERE part_id IN (1, 2) GROUP BY 1, 2)
  SELECT time, round(max(mx) FILTER (part_id = 1), 6) AS "Part1_Max", round(max(mn) FILTER (part_id = 1), 6) AS "Part1_Min", round(max(av) FILTER (part_id = 1), 6) AS "Part1_Avg", round(max(mx) FILTER (part_id = 2), 6) AS "Part2_Max", round(max(mn) FILTER (part_id = 2), 6) AS "Part2_Min", round(max(av) FILTER (part_id = 2), 6) AS "Part2_Avg" FROM g GROUP BY 1""")
def wide_part_history(s, d):
    series = P.part_state_statistics(Parts.by_id(1, 2).apply(T.element_states(s, d)), ["y_stress"])
    return rounded(P.wide(series, "y_stress"))


# Encodings

@query(f"""WITH {T.EV}, o AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS dl, round(value * 100)::BIGINT AS qv FROM ev), x AS (SELECT *, xor(qv, coalesce(lag(qv) OVER (PARTITION BY user_id ORDER BY t, event_id), 0)) AS xr, qv - coalesce(lag(qv) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS dq FROM o)
  SELECT event_id, round(dl, 6) AS delta, xr AS xor_delta, ((dq + 32768) % 65536 + 65536) % 65536 - 32768 AS short_delta, round(value, 4) AS back FROM x""")
def temporal_deltas(s, d):
    w = encode.series(["user_id"], ["t", "event_id"])
    e = T.event_series(s, d).withColumn("q", F.round(F.col("value") * 100).cast("long"))
    e = e.withColumns({"delta": encode.delta(F.col("value"), w), "xor_delta": encode.xor_delta(F.col("q"), w), "short_delta": encode.wrap16(encode.delta(F.col("q"), w)).cast("long")})
    return rounded(e.withColumn("back", near(encode.undelta(F.col("delta"), w), 4)).select("event_id", "delta", "xor_delta", "short_delta", "back"))


@query(f"""WITH {T.ES}, r AS (SELECT min(syy) AS lo, max(syy) AS hi FROM es) SELECT {KEY}, round(greatest(least((syy - lo) / (hi - lo), 1), 0) * 65535)::INTEGER AS syy_code FROM es, r""")
def linear_quantizer(s, d):
    return encode.quantize(T.element_states(s, d).select("row_id", "row_line", "part_id", "element_id", "syy"), ["syy"]).select("row_id", "row_line", "part_id", "element_id", "syy_code")


@query(f"""WITH {T.ES}, r AS (SELECT max(syy) AS hi FROM es) SELECT {KEY}, round(greatest(least((ln(greatest(syy, 2)) - ln(2)) / (ln(hi) - ln(2)), 1), 0) * 4095)::INTEGER AS code FROM es, r""")
def logarithmic_quantizer(s, d):
    e = T.element_states(s, d)
    return e.crossJoin(F.broadcast(e.agg(F.max("syy").alias("hi")))).select("row_id", "row_line", "part_id", "element_id", encode.logarithmic(F.col("syy"), 2.0, F.col("hi"), 12).alias("code"))

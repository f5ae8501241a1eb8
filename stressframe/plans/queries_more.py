"""Queries of selections, tensors, sets, output specifications, meshes, spectra and experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, tensor
from ..operators import compare as C
from ..operators import doe as D
from ..operators import mesh as M
from ..operators import parts as P
from ..operators import results as R
from ..operators import series as S
from ..operators.output import OutputSpec
from ..operators.query import Query
from ..operators.select import QUANTITIES, Parts, Quantities, States, Values
from . import tables as T
from . import templates
from .queries_mesh import FACES, GEO
from .queries_query import BASE, KEY, VMT, _rows, _vm
from .registry import query, rounded

# Selections


@query(f"WITH {T.PARTS} SELECT 'all' AS choice, count(*) AS n, true AS any FROM parts UNION ALL SELECT 'none', 0, false UNION ALL SELECT 'union', count(*) FILTER (material_id = 3 OR name LIKE 'a%' OR part_id = 5), count(*) FILTER (material_id = 3 OR name LIKE 'a%' OR part_id = 5) > 0 FROM parts")
def part_selections_counted(s, d):
    parts = T.part_table(s, d)
    choices = {"all": Parts.all(), "none": Parts.none(), "union": Parts.by_material(3) | Parts.by_glob("a*") | Parts.by_id(5)}
    return s.createDataFrame([(k, p.count(parts), p.has_matches(parts)) for k, p in choices.items()], "choice string, n long, any boolean")


@query(f"WITH {T.PARTS} SELECT name FROM parts WHERE brand = 'Brand#12' UNION SELECT name FROM parts WHERE kind LIKE '%A%' AND material_id > 40")
def union_of_part_classes(s, d):
    parts = T.part_table(s, d).withColumnsRenamed({"name": "shown", "brand": "name"})
    own = Parts.by_name("Brand#12").apply(parts).select("shown")
    other = Parts.by_property("material_id", 41).apply(T.part_table(s, d)).where(F.col("kind").contains("A")).select("name")
    return own.union(other).distinct().select(F.col("shown").alias("name"))


@query(BASE.replace("SELECT state_idx FROM", "SELECT DISTINCT round(time, 6) AS time FROM") + "state_idx < 3 OR state_idx >= last - 1")
def state_times(s, d):
    return rounded(States.times(States.any_of(States.first(3), States.last(2)), T.states(s, d)))


@query(f"WITH {T.ES}, {T.STATES} SELECT DISTINCT w AS state_idx FROM (SELECT (SELECT arg_min(state_idx, (abs(time - (0.0402 + i * 0.0033)), state_idx)) FROM st) AS w FROM range(6) t(i))")
def states_at_steps_of_time(s, d):
    return States.between(0.0402, 0.0568, 0.0033)(T.states(s, d)).select("state_idx")


@query(f"WITH {VMT} SELECT {KEY}, round(von_mises, 6) AS von_mises FROM vm WHERE sxx >= 0 AND sxx <> 0 AND tyz > 0 AND NOT (eps < 0)")
def values_by_sign(s, d):
    chosen = Values.non_zero("sxx") & Values.positive("tyz") & ~Values.negative("eps") & Values.accept_all() & ~Values.reject_all()
    return _rows(chosen.apply(_vm(s, d)), "von_mises")


@query(f"WITH {T.ES} SELECT element_id, state_idx, round(sxx, 6) AS sxx, row_number() OVER (ORDER BY part_id, time, element_id, row_id, row_line, sxx) AS i FROM es QUALIFY i <= 500")
def rows_sorted_by_keys(s, d):
    """The first 500 rows in the order of four keys; the number is that of a page of a report."""
    rows = R.sort_by(T.element_states(s, d), "part_id", "time", "element_id", "row_id", "row_line", "sxx").limit(500).select("element_id", "state_idx", "sxx").collect()
    return rounded(s.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "element_id long, state_idx int, sxx double, i long"))


@query(f"WITH {VMT}, n AS (SELECT max(state_idx) AS last FROM vm) SELECT 'element' AS entity, element_id, part_id, state_idx, time, round(von_mises, 6) AS von_mises, round({T.PRESSURE}, 6) AS pressure, round(eps, 6) AS effective_plastic_strain FROM vm, n WHERE part_id IN (2, 4, 6) AND state_idx > last - 12 AND von_mises > 20")
def fluent_query(s, d):
    chosen = Query(T.element_states(s, d)).parts(Parts.by_regex("Part_[246]")).states(States.last(12)).quantities("vm", "pressure", "eps").where(Values.compare("von_mises", ">", 20))
    return rounded(chosen.run())


# Tensors

@query(f"""WITH {T.ES}, a AS (SELECT *, (sxx + syy + szz) / 3 AS m FROM es) SELECT {KEY}, round(2 * (sxx + 1.5), 6) AS xx, round(2 * (syy + 1.5), 6) AS yy, round(2 * (txy + 0.5), 6) AS xy, round(m, 6) AS mean, round(sqrt(2.0 / 3 * ((sxx-m)*(sxx-m) + (syy-m)*(syy-m) + (szz-m)*(szz-m) + 2 * (txy*txy + tyz*tyz + tzx*tzx))), 6) AS strain_vm, abs(sxx) < 1e-12 AND abs(syy) < 1e-12 AS zero,
  4.0::DOUBLE AS uniaxial, round(sqrt(3) * 2, 6) AS shear FROM a""")
def tensor_algebra(s, d):
    t = tensor.stress()
    twice = (t + tensor.hydrostatic(F.lit(1.5)) + tensor.pure_shear(F.lit(0.5))).scale(2.0)
    e = T.element_states(s, d)
    return _rows(e.select("*", twice.xx.alias("xx"), twice.yy.alias("yy"), twice.xy.alias("xy"), t.mean().alias("mean"), t.strain_von_mises().alias("strain_vm"), (t - t.scale(0.0)).is_zero().alias("zero"), tensor.uniaxial(F.lit(4.0)).von_mises().alias("uniaxial"), tensor.pure_shear(F.lit(2.0)).von_mises().alias("shear")), "xx", "yy", "xy", "mean", "strain_vm", "zero", "uniaxial", "shear")


def _exact(s: SparkSession, d: str) -> DataFrame:
    """Element states whose components are such that every quantity compares alike in any engine: whole multiples of 1/8 of the axis stresses only."""
    e = T.element_states(s, d)
    return e.withColumns({c: F.round(F.col(c) * 8) / 8 for c in ("sxx", "syy", "szz", "txy", "tyz", "tzx", "eps")})


EX = T.ES + ", ex AS (SELECT row_id, row_line, part_id, element_id, state_idx, time, " + ", ".join(f"round({c} * 8, 0) / 8 AS {c}" for c in ("sxx", "syy", "szz", "txy", "tyz", "tzx", "eps")) + " FROM es)"
AXIS = {"x_stress": "sxx", "y_stress": "syy", "z_stress": "szz", "xy_stress": "txy", "yz_stress": "tyz", "zx_stress": "tzx", "effective_plastic_strain": "eps"}


@query(f"WITH {EX} SELECT part_id, state_idx, " + ", ".join(f"max({c}) AS {q}_max, min({c}) AS {q}_min, round(avg({c}), 6) AS {q}_avg, round(sqrt(avg({c} * {c})), 6) AS {q}_rms, arg_max(element_id, ({c}, -element_id)) AS {q}_max_element, arg_min(element_id, ({c}, element_id)) AS {q}_min_element" for q, c in AXIS.items()) + " FROM ex GROUP BY 1, 2")
def seven_quantities_in_one_pass(s, d):
    """All statistics and both elements of seven quantities, by the library's one aggregation."""
    return rounded(P.part_state_statistics(_exact(s, d), list(AXIS)).drop("time"))


@query(f"WITH {EX}, v AS (SELECT *, {T.VM} AS vm FROM ex) SELECT part_id, state_idx, round(max(vm), 6) AS top, round(min(vm), 6) AS low, round(sqrt(avg(vm * vm)), 6) AS rms, 0.0::DOUBLE AS lost FROM v GROUP BY 1, 2")
def part_state_extremes_and_their_elements(s, d):
    """The library's element of the largest value has that value: nothing is lost."""
    e = _exact(s, d)
    stats = P.part_state_statistics(e, ["von_mises"])
    own = e.select("part_id", "state_idx", "element_id", tensor.stress().von_mises().alias("v")).groupBy("part_id", "state_idx", "element_id").agg(F.max("v").alias("v"))
    both = stats.join(own.withColumnRenamed("element_id", "von_mises_max_element"), ["part_id", "state_idx", "von_mises_max_element"])
    return rounded(both.select("part_id", "state_idx", F.col("von_mises_max").alias("top"), F.col("von_mises_min").alias("low"), F.col("von_mises_rms").alias("rms"), (F.col("von_mises_max") - F.col("v")).alias("lost")))


@query(f"WITH {EX} SELECT part_id, max(syy) AS peak, arg_max(element_id, (syy, -state_idx, -element_id)) AS element_id, arg_max(state_idx, (syy, -state_idx, -element_id)) AS state_idx FROM ex GROUP BY 1")
def peak_elements_of_parts(s, d):
    return P.peak_elements(_exact(s, d), "y_stress")


@query(f"WITH {T.ES}, t AS (SELECT count(DISTINCT state_idx) AS n FROM es) SELECT part_id, count(DISTINCT state_idx) AS states, round(count(DISTINCT state_idx) * 100.0 / max(n), 6) AS percent FROM es, t GROUP BY 1")
def part_history_progress(s, d):
    e = T.element_states(s, d)
    return rounded(P.progress(P.part_state_statistics(e, ["y_stress"]), e.select("state_idx").distinct().count()))


SETS = "sets AS (SELECT part_id, part_id % 5 AS set_id FROM (SELECT DISTINCT part_id FROM ex))"


@query(f"WITH {EX}, {SETS}, a AS (SELECT set_id, state_idx, " + ", ".join(f"{'min' if q == 'yz_stress' else 'max'}({c}) AS {q}" for q, c in AXIS.items()) + " FROM ex JOIN sets USING (part_id) GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT set_id, '{q}' AS field, {'min' if q == 'yz_stress' else 'max'}({q}) AS peak, {'arg_min' if q == 'yz_stress' else 'arg_max'}(state_idx, ({q}, {'' if q == 'yz_stress' else '-'}state_idx)) AS state_idx FROM a GROUP BY 1" for q in AXIS))
def seven_set_fields_in_one_pass(s, d):
    e = _exact(s, d)
    sets = e.select("part_id").distinct().withColumn("set_id", F.col("part_id") % 5)
    return P.all_set_fields(e, sets, {q: q != "yz_stress" for q in AXIS})


def _node_states(s: SparkSession, d: str) -> DataFrame:
    n, k = T.nodes(s, d), F.col("state_idx")
    each = n.crossJoin(F.broadcast(s.range(5).select(F.col("id").cast("int").alias("state_idx"))))  # five rows
    i = F.col("node_id")
    return each.select("node_id", "state_idx", (k * 0.5).alias("time"), *(F.col(c).alias(f"{c}0") for c in "xyz"), (F.col("x") + (i % 7) * k).alias("x"), "y", "z", ((i % 5) * 1.0 - k).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"), *(F.lit(None).cast("double").alias(c) for c in ("ax", "ay", "az")))


@query(f"""WITH {T.SOLIDS}, {T.NODES}, r AS (SELECT node_id % 3 AS set_id, k::INTEGER AS state_idx, k * 0.5::DOUBLE AS time, node_id, unnest(['disp_mag', 'vel_mag']) AS field, unnest([(node_id % 7) * k * 1.0::DOUBLE, abs((node_id % 5) * 1.0::DOUBLE - k)]) AS value FROM nodes, range(5) t(k)),
  g AS (SELECT set_id, field, state_idx, min(time) AS time, max(value) AS value, arg_max(node_id, (value, -node_id)) AS node_id FROM r GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY set_id, field ORDER BY value DESC, state_idx) = 1 AS peak FROM g""")
def node_set_metrics(s, d):
    members = T.nodes(s, d).select("node_id", (F.col("node_id") % 3).alias("set_id"))
    return P.node_set_metrics(_node_states(s, d), members)


@query(f"""WITH {EX}, r AS (SELECT element_id % 4 AS set_id, state_idx, time, element_id, eps AS value FROM ex WHERE element_id % 3 = 0), g AS (SELECT set_id, 'eff_plastic_strain' AS field, state_idx, min(time) AS time, max(value) AS value, arg_max(element_id, (value, -element_id)) AS element_id FROM r GROUP BY 1, 2, 3)
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY value DESC, state_idx) = 1 AS peak FROM g""")
def segment_set_metrics(s, d):
    e = _exact(s, d)
    parents = e.where("element_id % 3 = 0").select((F.col("element_id") % 4).alias("set_id"), "element_id")
    return P.segment_set_metrics(e, parents).where("field = 'eff_plastic_strain'")


@query(f"""WITH {EX}, u AS (SELECT 'part' AS kind, part_id::VARCHAR AS target, * FROM ex UNION ALL SELECT 'surface', 'top', * FROM ex WHERE element_id % 2 = 0 UNION ALL SELECT 'surface', 'side', * FROM ex WHERE element_id % 5 = 0)
  SELECT kind, target, state_idx, max(syy) AS y_stress_max, min(syy) AS y_stress_min, round(avg(syy), 6) AS y_stress_avg, arg_max(element_id, (syy, -element_id)) AS y_stress_max_element, max(txy) AS xy_stress_max, min(txy) AS xy_stress_min, round(avg(txy), 6) AS xy_stress_avg, arg_max(element_id, (txy, -element_id)) AS xy_stress_max_element FROM u GROUP BY 1, 2, 3""")
def single_pass_with_surfaces(s, d):
    e = _exact(s, d)
    on = e.select("element_id").distinct()
    surfaces = on.where("element_id % 2 = 0").select(F.lit("top").alias("surface"), "element_id").union(on.where("element_id % 5 = 0").select(F.lit("side").alias("surface"), "element_id"))
    return rounded(P.single_pass(e, ["y_stress", "xy_stress"], surfaces))


@query(f"""WITH {T.SOLIDS}, sg AS (SELECT elem_idx AS seg, node_ids[5:8] AS n FROM solids UNION ALL SELECT elem_idx + 100000, [node_ids[1], node_ids[2], 999999, 999998] FROM solids), x AS (SELECT seg, unnest(list_distinct(n)) AS node FROM sg), e AS (SELECT elem_idx, unnest(list_distinct(node_ids)) AS node FROM solids),
  c AS (SELECT seg, elem_idx, count(*) AS n FROM x JOIN e USING (node) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT seg AS segment_id, arg_min(elem_idx, (-n, elem_idx)) AS elem_idx, max(n) AS shared FROM c GROUP BY 1""")
def segment_parent_solids(s, d):
    solids = T.solids(s, d)
    four = solids.select(F.col("elem_idx").alias("segment_id"), F.slice("node_ids", 5, 4).alias("node_ids"))
    two = solids.select((F.col("elem_idx") + 100000).alias("segment_id"), F.array(F.col("node_ids")[0], F.col("node_ids")[1], F.lit(999999), F.lit(999998)).alias("node_ids"))
    return P.segment_parents(four.union(two), solids)


# Results

@query(f"WITH {EX} SELECT element_id, arg_max(syy, (time, row_id, row_line, syy)) AS last, round(sqrt(sum(syy * syy)), 6) AS root FROM ex GROUP BY 1")
def last_and_custom_aggregates(s, d):
    e = _exact(s, d)
    last = e.groupBy("element_id").agg(F.max_by("syy", F.struct("time", "row_id", "row_line", "syy")).alias("last"))
    return rounded(last.join(R.custom(e, "syy", lambda c: F.sqrt(F.sum(c * c))).withColumnRenamed("value", "root"), "element_id"))


@query(f"WITH {EX}, l AS (SELECT element_id, state_idx, time, max(syy) AS syy FROM ex GROUP BY 1, 2, 3) SELECT element_id, arg_max(syy, (time, state_idx)) AS last, round(max(syy) - min(syy), 6) AS range, count(*) AS count FROM l GROUP BY 1")
def element_last_values(s, d):
    one = _exact(s, d).groupBy("element_id", "state_idx", "time").agg(F.max("syy").alias("syy"))
    latest = one.groupBy("element_id").agg(R.aggregate("syy", "last").alias("last"), R.aggregate("syy", "range").alias("range"), R.aggregate("syy", "count").alias("count"))
    return rounded(latest)


@query(f"WITH {EX}, a AS (SELECT max(syy) AS mx, min(syy) AS mn, avg(syy) AS av, stddev_samp(syy) AS sd, sum(syy) AS sm, count(syy)::DOUBLE AS n, quantile_cont(syy, 0.5) AS md FROM ex) SELECT unnest(['max', 'min', 'mean', 'sd', 'sum', 'count', 'range', 'median', 'nothing']) AS kind, round(unnest([mx, mn, av, sd, sm, n, mx - mn, md, 0.0]), 4) AS value FROM a")
def scalar_aggregates(s, d):
    e, out = _exact(s, d), None
    for kind in ("max", "min", "mean", "sd", "sum", "count", "range", "median"):
        one = R.scalar(e, "syy", kind).select(F.lit(kind).alias("kind"), "value")
        out = one if out is None else out.union(one)
    return rounded(out.union(R.scalar(e.where("false"), "syy", "sd").select(F.lit("nothing").alias("kind"), "value")), 4)


@query(f"WITH {T.ES} SELECT part_id, round(quantile_cont(sxx, 0.9) - quantile_cont(sxx, 0.1), 6) AS value FROM es GROUP BY 1")
def custom_pandas_aggregate(s, d):
    return rounded(R.custom_pandas(T.element_states(s, d), "sxx", lambda v: v.quantile(0.9) - v.quantile(0.1), ("part_id",)))


@query(f"WITH {EX}, l AS (SELECT element_id, part_id, state_idx, time, max(sxx) AS sxx, max(syy) AS syy FROM ex GROUP BY 1, 2, 3, 4) SELECT element_id, part_id, round(max(sxx * 1e6 / 1e3), 3) AS sxx, round(avg(syy), 3) AS syy FROM l GROUP BY 1, 2")
def output_specification(s, d):
    one = _exact(s, d).groupBy("element_id", "part_id", "state_idx", "time").agg(F.max("sxx").alias("sxx"), F.max("syy").alias("syy"))
    spec = OutputSpec().with_fields("sxx", "syy").with_aggregation("mean").with_aggregation("max", "sxx").with_unit("sxx", "MPa", "kPa").with_precision(None)
    return rounded(spec.apply(one), 3)


@query(f"WITH {VMT} SELECT {KEY}, round({T.PRESSURE}, 6) AS pressure, round(sxx, 6) AS x_stress, round(von_mises, 6) AS von_mises, round(CASE WHEN sxx + syy + szz < 0 THEN -von_mises ELSE von_mises END, 6) AS signed_von_mises FROM vm")
def quantity_projection(s, d):
    chosen = Quantities(["vm", "pressure"]).add("x_stress", "signed_von_mises").remove("von_mises").add("von_mises")
    e = T.element_states(s, d)
    return rounded(e.select("row_id", "row_line", "part_id", "element_id", *chosen.columns()))


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT node_id, k::INTEGER AS state_idx, round((node_id % 7) * k * 1.0, 6) AS x_displacement, round((node_id % 7) * k * 1.0, 6) AS displacement, round((node_id % 5) * 1.0 - k, 6) AS x_velocity, round(abs((node_id % 5) * 1.0 - k), 6) AS velocity FROM nodes, range(5) t(k)")
def motion_quantities(s, d):
    return rounded(_node_states(s, d).select("node_id", "state_idx", *(QUANTITIES[q]().alias(q) for q in ("x_displacement", "displacement", "x_velocity", "velocity"))))


@query("SELECT n_nationkey AS levels, ceil(log2(greatest(n_nationkey, 2)))::INTEGER AS bits FROM nation")
def automatic_bits(s, d):
    rows = [(r[0], encode.bits_for(r[0])) for r in T.read(s, d, "nation").select("n_nationkey").collect()]  # 25 rows
    return s.createDataFrame(rows, "levels int, bits int")


@query(f"WITH {T.ES}, r AS (SELECT min(eps) AS lo, max(eps) AS hi FROM es) SELECT {KEY}, round(greatest(least((eps - lo) / (hi - lo), 1), 0) * 65535)::INTEGER AS code, 32768::INTEGER AS flat, round(lo + round(greatest(least((eps - lo) / (hi - lo), 1), 0) * 65535) / 65535 * (hi - lo), 6) AS back FROM es, r")
def strain_quantizer(s, d):
    e = T.element_states(s, d)
    ranged = e.crossJoin(F.broadcast(e.agg(F.min("eps").alias("lo"), F.max("eps").alias("hi"))))  # one row
    code = encode.strain(F.col("eps"), F.col("lo"), F.col("hi"))
    return rounded(ranged.withColumn("code", code).select("row_id", "row_line", "part_id", "element_id", "code", encode.strain(F.col("eps"), F.lit(0.5), F.lit(0.5) + F.lit(1e-16)).alias("flat"), encode.unlinear(F.col("code"), F.col("lo"), F.col("hi")).alias("back")))


# Templates, jobs and settings

@query(f"WITH {EX} SELECT 'history' AS source, part_id, state_idx, max(syy) AS value FROM ex GROUP BY 2, 3 UNION ALL SELECT 'zones', part_id, state_idx, syy FROM ex WHERE syy > 90 AND state_idx >= 0")
def template_answers(s, d):
    """A saved and loaded template with other parameters, and one by an alias."""
    e = _exact(s, d)
    own = templates.load(templates.save(templates.Template("max_stress_history", templates.TEMPLATES["max_stress_history"].answer, "stress", {"quantity": "y_stress"})))
    templates.register(templates.TEMPLATES["critical_zones"], "hot_spots")
    history = own.run(e).select(F.lit("history").alias("source"), "part_id", "state_idx", F.col("y_stress_max").alias("value"))
    zones = templates.TEMPLATES["hot_spots"].run(e, quantity="y_stress", limit=90.0).select(F.lit("zones").alias("source"), "part_id", "state_idx", F.col("y_stress").alias("value"))
    return history.union(zones)


@query(f"""WITH {T.ES}, vm AS (SELECT *, {T.VM} AS v FROM es), n AS (SELECT count(DISTINCT (part_id, state_idx)) AS k FROM es) SELECT 'max_*' AS asked, t AS template, k AS answers FROM n, (VALUES ('max_stress_history'), ('max_strain_history')) x(t)
  UNION ALL SELECT 'stress', 'max_stress_history', k FROM n UNION ALL SELECT 'stress', 'critical_zones', count(*) FROM vm WHERE v > 500 UNION ALL SELECT 'stress', 'part_comparison', count(DISTINCT part_id) FROM es WHERE part_id IN (1, 2)""")
def template_search(s, d):
    """What is found by pattern and by category, each asked of the element states."""
    e = T.element_states(s, d)
    own = {n for n in templates.TEMPLATES if n == templates.TEMPLATES[n].name}
    found = {"max_*": templates.search("max_*"), "stress": templates.search("*", "stress"), "none": templates.search("nothing*")}
    rows = [templates.TEMPLATES[n].run(e).agg(F.lit(asked).alias("asked"), F.lit(n).alias("template"), F.count("*").alias("answers")) for asked, names in found.items() for n in names if n in own]
    return reduce(DataFrame.union, rows)


@query(f"""WITH {T.ES}, vm AS (SELECT *, {T.VM} AS v FROM es), ps AS (SELECT part_id, state_idx, max(v) AS v, max(eps) AS e FROM vm GROUP BY 1, 2), {T.ENERGIES}, {T.FORCES}, la AS (SELECT * FROM vm WHERE state_idx = (SELECT max(state_idx) FROM vm))
  SELECT 'max_stress_history' AS template, count(*) AS answers, round(sum(v), 4) AS total FROM ps UNION ALL SELECT 'max_strain_history', count(*), round(sum(e), 4) FROM ps UNION ALL SELECT 'final_state', count(*), round(sum(v), 4) FROM la UNION ALL SELECT 'critical_zones', count(*), round(sum(v), 4) FROM vm WHERE v > 60
  UNION ALL SELECT 'element_history', count(DISTINCT element_id), count(*) FROM es WHERE element_id = 3 UNION ALL SELECT 'part_comparison', count(*), round(sum(v), 4) FROM (SELECT part_id, max(v) AS v FROM vm WHERE part_id IN (1, 2) GROUP BY 1)
  UNION ALL SELECT 'displacement_envelope', count(*), round(sum(m), 4) FROM (SELECT state_idx, max(sqrt(sxx*sxx + (syy-sxx)*(syy-sxx) + szz*szz)) AS m FROM es GROUP BY 1) UNION ALL SELECT 'energy_balance', count(DISTINCT run_id), NULL FROM energies UNION ALL SELECT 'contact_force', count(DISTINCT (run_id, interface_id)), NULL FROM forces
  UNION ALL SELECT 'failure', count(*), round(sum(eps), 4) FROM es WHERE eps > 0.005""")
def every_template(s, d):
    """All ten templates on the tables that they ask."""
    e, run = T.element_states(s, d), lambda name, data, **given: templates.TEMPLATES[name].run(data, **given)
    placed = e.select("*", F.col("sxx").alias("x"), F.col("syy").alias("y"), F.col("szz").alias("z"), F.lit(0.0).alias("x0"), F.col("sxx").alias("y0"), F.lit(0.0).alias("z0"))
    none = F.lit(None).cast("double")
    asked = [
        ("max_stress_history", run("max_stress_history", e), F.sum("von_mises_max")), ("max_strain_history", run("max_strain_history", e), F.sum("effective_plastic_strain_max")), ("final_state", run("final_state", e), F.sum("von_mises")),
        ("critical_zones", run("critical_zones", e, limit=60.0), F.sum("von_mises")), ("element_history", run("element_history", e, element_id=3), F.sum(F.size("series")).cast("double")), ("part_comparison", run("part_comparison", e), F.sum("global_max")),
        ("displacement_envelope", run("displacement_envelope", placed), F.sum("max")), ("energy_balance", run("energy_balance", T.energies(s, d)), F.max(none)), ("contact_force", run("contact_force", T.forces(s, d)), F.max(none)),
        ("failure", run("failure", e, limit=0.005), F.sum("effective_plastic_strain")),
    ]
    return rounded(reduce(DataFrame.union, (df.agg(F.lit(name).alias("template"), F.count("*").alias("answers"), total.alias("total")) for name, df, total in asked)), 4)


@query(f"WITH {T.ES} SELECT {KEY}, state_idx, sxx FROM es WHERE state_idx BETWEEN 40 AND 60 AND sxx > 45")
def merged_settings(s, d):
    """A question whose limits come from defaults, a file and the environment, later ones first."""
    base = {"states": {"first": 40, "last": 50}, "limit": 30.0}
    found = templates.merged(base, {"limit": 45.0}, templates.from_environment({"STRESSFRAME_STATES__LAST": "60", "OTHER": "1"}))
    return T.element_states(s, d).where(F.col("state_idx").between(found["states"]["first"], found["states"]["last"]) & (F.col("sxx") > found["limit"])).select("row_id", "row_line", "part_id", "element_id", "state_idx", "sxx")


@query(f"WITH {EX} SELECT 'parts_all' AS job, part_id AS target, state_idx, round(max(eps), 6) AS value FROM ex GROUP BY 2, 3 UNION ALL SELECT 'sets', part_id % 5, arg_max(state_idx, (v, -state_idx)), max(v) FROM (SELECT part_id % 5 AS part_id, state_idx, max(syy) AS v FROM ex GROUP BY 1, 2) GROUP BY part_id UNION ALL SELECT 'beams', part_id, state_idx, max(sxx) FROM ex GROUP BY 2, 3")
def analysis_jobs(s, d):
    """A job list: two jobs of parts that become one scan, one of sets and one of beams."""
    e = _exact(s, d)
    tables = {"element_states": e, "set_members": e.select("part_id").distinct().withColumn("set_id", F.col("part_id") % 5), "beam_states": e.select("part_id", "element_id", "state_idx", F.array("sxx").alias("words"))}
    jobs = templates.load_jobs('{"analysis_jobs": [{"type": "von_mises"}, {"type": "eff_plastic_strain"}, {"type": "set_report", "name": "sets", "fields": {"y_stress": true}}, {"type": "beam", "name": "beams"}]}')
    out = templates.run_jobs(tables, jobs)
    parts = out["parts_all"].select(F.lit("parts_all").alias("job"), F.col("part_id").alias("target"), "state_idx", F.col("effective_plastic_strain_max").alias("value"))
    sets = out["sets"].select(F.lit("sets"), "set_id", "state_idx", "peak")
    beams = out["beams"].where("component = 'axial'").select(F.lit("beams"), "part_id", "state_idx", "max")
    return rounded(parts.union(sets).union(beams))


# Meshes

@query(f"WITH {FACES}, sh AS (SELECT elem_idx, part_id, node_ids[1:4] AS nodes FROM solids WHERE elem_idx % 3 = 0) SELECT 'solid' AS kind, count(*) AS n, count(DISTINCT elem_idx) AS elements FROM ext UNION ALL SELECT 'shell', count(*), count(DISTINCT elem_idx) FROM sh UNION ALL SELECT 'both sides', 2 * count(*), count(DISTINCT elem_idx) FROM sh")
def faces_of_one_class(s, d):
    solids = T.solids(s, d)
    shells = solids.where("elem_idx % 3 = 0").select(F.lit("SHELL").alias("etype"), "elem_idx", "elem_id", "part_id", F.slice("node_ids", 1, 4).alias("node_ids"))
    both = solids.unionByName(shells)
    kinds = {"solid": M.exterior_faces(both, shells=False), "shell": M.exterior_faces(both, solids=False), "both sides": M.exterior_faces(both, solids=False, bottom=True)}
    out = None
    for kind, faces in kinds.items():
        one = faces.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_distinct("elem_idx").alias("elements"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {GEO} SELECT elem_idx, nodes[1]::INTEGER AS n0, nodes[3]::INTEGER AS n2, k::INTEGER AS state_idx, round(nx * (1 - 2 * k), 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz FROM geo, range(2) t(k) WHERE abs(ny) < 1e-9 AND abs(nz) < 1e-9 AND k = 0")
def face_normals_by_state(s, d):
    """Normals at two states, the second turned over; here those along x at the first."""
    nodes = T.nodes(s, d)
    states = nodes.withColumn("state_idx", F.lit(0)).union(nodes.select("node_id", (-F.col("x")).alias("x"), "y", "z").withColumn("state_idx", F.lit(1)))
    faces = M.exterior_faces(T.solids(s, d)).select("etype", "elem_idx", "elem_id", "part_id", "nodes", F.explode(F.array(F.lit(0), F.lit(1))).alias("state_idx"))
    each = faces.select("etype", "elem_idx", "nodes", "state_idx", F.posexplode("nodes").alias("i", "node_id")).join(states, ["node_id", "state_idx"])
    held = each.groupBy("etype", "elem_idx", "nodes", "state_idx").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("x", "y", "z").alias("p")))).alias("p"))
    found = M.face_geometry(held.select("elem_idx", "nodes", "state_idx", *(F.col("p")[i].alias(f"p{i}") for i in range(4))))
    return rounded(found.where("state_idx = 0 and abs(ny) < 1e-9 and abs(nz) < 1e-9").select("elem_idx", F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", F.lit(2)).alias("n2"), "state_idx", "nx", "ny", "nz"), 5)


@query(f"""WITH {GEO}, {EX}, f AS (SELECT 'top' AS surface, * FROM geo WHERE nz >= cos(radians(45)) - 1e-12 UNION ALL SELECT 'bottom', * FROM geo WHERE -nz >= cos(radians(45)) - 1e-12),
  b AS (SELECT surface, state_idx, sxx*nx*nx + syy*ny*ny + szz*nz*nz + 2*(txy*nx*ny + tyz*ny*nz + tzx*nz*nx) AS nrm, eps FROM f JOIN (SELECT * EXCLUDE (part_id), part_id AS sup FROM ex) e ON e.sup = f.elem_idx)
  SELECT surface, state_idx, round(max(nrm), 5) AS e_normal_max, round(min(nrm), 5) AS e_normal_min, round(avg(nrm), 5) AS e_normal_avg, round(max(eps), 6) AS eps_max, true AS has_tensor FROM b GROUP BY 1, 2""")
def default_surfaces_strain(s, d):
    """Strain on the surfaces of a job that names none."""
    geometry, faces = M.face_geometry(M.with_corners(M.exterior_faces(T.solids(s, d)), T.nodes(s, d))), None
    for name, direction, degrees in M.DEFAULT_SURFACES:
        one = M.facing(geometry, direction, degrees).withColumn("surface", F.lit(name))
        faces = one if faces is None else faces.unionByName(one)
    names = {"sxx": "exx", "syy": "eyy", "szz": "ezz", "txy": "exy", "tyz": "eyz", "tzx": "ezx"}
    states = _exact(s, d).withColumns({"etype": F.lit("SOLID"), "elem_idx": F.col("part_id").cast("int")}).withColumnsRenamed(names)
    out = M.surface_strain(faces, states)
    return rounded(out.withColumn("eps_max", F.round("eps_max", 6)).select("surface", "state_idx", "e_normal_max", "e_normal_min", "e_normal_avg", "eps_max", "has_tensor"), 5)


HEX8 = f"{T.SOLIDS}, {T.NODES}, cn AS (SELECT elem_id, part_id, i, n.x, n.y, n.z FROM (SELECT elem_id, part_id, generate_subscripts(node_ids, 1) AS i, unnest(node_ids) AS node_id FROM solids) JOIN nodes n USING (node_id)), h AS (SELECT elem_id, part_id, " + ", ".join(f"max({c}) FILTER (i = {i + 1}) AS {c}{i}" for i in range(8) for c in "xyz") + " FROM cn GROUP BY 1, 2)"


def _tet(a: int, b: int, c: int, d: int) -> str:
    u, v, w = ([f"({k}{o}-{k}{a})" for k in "xyz"] for o in (b, c, d))
    return f"(({u[1]}*{v[2]}-{u[2]}*{v[1]})*{w[0]} + ({u[2]}*{v[0]}-{u[0]}*{v[2]})*{w[1]} + ({u[0]}*{v[1]}-{u[1]}*{v[0]})*{w[2]}) / 6"


HEXV = " + ".join(_tet(*t) for t in ((0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6)))


@query(f"WITH {HEX8}, v AS (SELECT *, abs({HEXV}) AS v, ({'+'.join(f'x{i}' for i in range(8))}) / 8 AS cx FROM h), p AS (SELECT part_id, sum(v) AS volume, sum(v * cx) / sum(v) AS centroid_x FROM v GROUP BY 1) SELECT part_id, round(volume, 6) AS volume, round(volume * (part_id + 1), 6) AS mass, round(centroid_x, 6) AS centroid_x FROM p WHERE volume >= 3.5")
def part_volume_mass_and_centroid(s, d):
    """Properties derived from the mesh, and a selection by one of them."""
    solids = T.solids(s, d)
    density = solids.select("part_id", (F.col("part_id") + 1.0).alias("density")).distinct()
    found = M.part_properties(M.solid_corners(solids, T.nodes(s, d)), density)
    return rounded(Parts.by_property("volume", 3.5).apply(found).select("part_id", "volume", "mass", "centroid_x"))


@query(f"WITH {HEX8} SELECT elem_id, round({_tet(0, 1, 3, 4)}, 6) AS tet_volume, round(-({_tet(0, 1, 3, 4)}), 6) AS turned, round({HEXV}, 6) AS hexa_volume FROM h")
def solid_volumes(s, d):
    """Solids as they are, and with four different corners: stored as hexahedra with one corner five times, straight and turned over."""
    c = M.solid_corners(T.solids(s, d), T.nodes(s, d))

    def folded(*order: int):
        at = [*order, *[order[-1]] * (8 - len(order))]
        return M.solid_volume([tensor.Vector(*(F.col(f"p{i}.{k}") for k in "xyz")) for i in at], F.array(*(F.col("node_ids")[i] for i in at)))

    return rounded(c.select("elem_id", folded(0, 1, 3, 4).alias("tet_volume"), folded(0, 3, 1, 4).alias("turned"), M.solid_volume([M.corner(i) for i in range(8)], F.col("node_ids")).alias("hexa_volume")))


@query(f"WITH {T.SOLIDS} SELECT elem_id, round(sqrt(2.0 / 3 * (0.02*0.02 + 0.01*0.01 + 0.01*0.01)) * (elem_id % 3), 6) AS strain, true AS flat_is_null FROM solids")
def degenerate_solid_strain(s, d):
    """A wedge (a corner three times among the first) stretched along x and shortened along the others; one without volume has none."""
    k = (F.col("elem_id") % 3).cast("double")
    places = ((0, 0, 0), (2, 0, 0), (2, 0, 0), (0, 1, 0), (0, 0, 3))
    one = lambda x, y, z: F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("xyz", (x, y, z), strict=True)), (0.02 * x * k).alias("u"), (-0.01 * y * k).alias("v"), (-0.01 * z * k).alias("w"))
    full, flat = F.array(*(one(*p) for p in places)), F.array(*(one(*p) for p in places[:4]))
    own = M.degenerate_strains(T.solids(s, d).select("elem_id", full.alias("corners"), flat.alias("flat")), "corners")
    return rounded(M.degenerate_strains(own, "flat", "flat_strain").select("elem_id", "strain", F.col("flat_strain").isNull().alias("flat_is_null")))


EDGES = "[[1,2],[2,3],[3,4],[4,1],[5,6],[6,7],[7,8],[8,5],[1,5],[2,6],[3,7],[4,8]]"


@query(f"""WITH {T.SOLIDS}, {T.NODES}, e AS (SELECT elem_idx, part_id, node_ids, unnest({EDGES}) AS p FROM solids), q AS (SELECT elem_idx, part_id, a.x AS ax, a.y AS ay, a.z - 1.1 AS da, b.x AS bx, b.y AS by_, b.z - 1.1 AS db FROM e JOIN nodes a ON a.node_id = node_ids[p[1]] JOIN nodes b ON b.node_id = node_ids[p[2]]),
  k AS (SELECT *, da / (da - db) AS t FROM q WHERE (da < 0 AND db >= 0) OR (da >= 0 AND db < 0)) SELECT elem_idx, part_id, count(*) AS corners, round(avg(ax + (bx - ax) * t), 5) AS x, round(avg(ay + (by_ - ay) * t), 5) AS y FROM k GROUP BY 1, 2""")
def section_clip_centres(s, d):
    cut = M.section_clip(T.solids(s, d), T.nodes(s, d), (0.0, 0.0, 1.1), (0.0, 0.0, 1.0))
    each = cut.select("elem_idx", "part_id", "corners", F.explode("polygon").alias("p"))
    return rounded(each.groupBy("elem_idx", "part_id", "corners").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y")), 5)


@query(f"""WITH {T.SOLIDS}, {T.NODES}, e AS (SELECT elem_idx, node_ids, unnest({EDGES}) AS p FROM solids), q AS (SELECT elem_idx, CASE WHEN abs(a.z - 2.3) <= 0.4 THEN 0 ELSE a.z - 2.3 END AS da, CASE WHEN abs(b.z - 2.3) <= 0.4 THEN 0 ELSE b.z - 2.3 END AS db FROM e JOIN nodes a ON a.node_id = node_ids[p[1]] JOIN nodes b ON b.node_id = node_ids[p[2]])
  SELECT elem_idx, count(*) AS corners FROM q WHERE (da < 0 AND db >= 0) OR (da >= 0 AND db < 0) GROUP BY 1""")
def section_clip_of_a_slab(s, d):
    return M.section_clip(T.solids(s, d), T.nodes(s, d), (0.0, 0.0, 2.3), (0.0, 0.0, 1.0), slab=0.8).select("elem_idx", "corners")


# Spectra

def _clocked(s: SparkSession, d: str) -> DataFrame:
    """events as evenly sampled series: a hundred samples a second."""
    w = "row_number() over (partition by user_id order by event_id) - 1"
    return T.event_series(s, d).select("user_id", (F.expr(w) * 0.01).alias("t"), "value")


CLOCKED = "cl AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value - avg(value) OVER (PARTITION BY user_id) AS y, value FROM events)"


@query(f"""WITH {CLOCKED}, f AS (SELECT user_id, n, k, sqrt(pow(sum(y * cos(2 * pi() * k * i / n)), 2) + pow(sum(y * sin(2 * pi() * k * i / n)), 2)) * 2 / n AS a FROM cl, range(1, 2000) t(k) WHERE k <= n // 2 GROUP BY 1, 2, 3)
  SELECT user_id, round(arg_max(k, (round(a, 9), -k)) / max(n) / 0.01, 5) AS frequency, round(max(a), 5) AS amplitude FROM f GROUP BY 1""")
def spectral_peaks(s, d):
    return rounded(S.dominant_frequency(_clocked(s, d), "user_id", "t", "value"), 5)


@query(f"""WITH RECURSIVE {CLOCKED}, sm AS (SELECT user_id, i, value FROM cl WHERE n >= 3), b AS (SELECT j, 10.0 * pow(2, j / 3.0::DOUBLE) AS freq FROM range(8) t(j)),
  r AS (SELECT user_id, j, freq, 2 * pi() * freq AS w, 0::BIGINT AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, -value AS acc, 0.0::DOUBLE AS peak FROM sm, b WHERE i = 0
    UNION ALL SELECT user_id, j, freq, w, i + 1, u1 + 0.000025 * acc1, v1 + 0.005 * acc1, acc1, greatest(peak, abs(2 * 0.05 * w * (v1 + 0.005 * acc1) + w * w * (u1 + 0.000025 * acc1)))
      FROM (SELECT q.user_id, j, freq, w, q.i, peak, u1, v1, (-s.value - 2 * 0.05 * w * v1 - w * w * u1) / (1 + 0.05 * w * 0.01 + w * w * 0.0001 / 4) AS acc1 FROM (SELECT *, u + 0.01 * v + 0.000025 * acc AS u1, v + 0.005 * acc AS v1 FROM r) q JOIN sm s ON s.user_id = q.user_id AND s.i = q.i + 1) z)
  SELECT user_id, round(freq, 5) AS frequency, round(max(peak), 3) AS response FROM r GROUP BY user_id, freq""")
def shock_responses(s, d):
    return S.shock_spectrum(_clocked(s, d), "user_id", "t", "value", 10.0, 51.0).select("user_id", F.round(F.col("frequency") + 3.1e-10, 5).alias("frequency"), F.round(F.col("response") + 3.1e-10, 3).alias("response"))


# Experiments and comparisons

@query(f"WITH {T.DOE}, q AS (SELECT quantile_cont(peak_g, 0.75) AS q FROM doe) SELECT doe.part_id, round(max(peak_g), 6) AS max_peak_g, round(avg(peak_g), 6) AS mean_peak_g, max(peak_stress) AS max_peak_stress, max(peak_disp) AS max_peak_disp, arg_min(face, (-peak_g, face, pos_id)) AS face, arg_min(pos_id, (-peak_g, face, pos_id)) AS pos_id, count(*) FILTER (peak_g >= q AND q > 0) AS over_quartile, CASE WHEN doe.part_id LIKE '%1' THEN 45.0::DOUBLE END AS yield_stress FROM doe, q GROUP BY doe.part_id")
def part_drill_down(s, d):
    x = T.doe(s, d)
    yields = x.select("part_id").distinct().where(F.col("part_id").endswith("1")).withColumn("yield_stress", F.lit(45.0))
    return rounded(D.drill_down(x, yields))


@query(f"WITH {T.DOE}, m AS (SELECT max(peak_g) AS a, max(peak_stress) AS b FROM doe), v AS (SELECT *, 0.7 * greatest(least(peak_g / a, 1), 0) + 0.3 * greatest(least(peak_stress / b, 1), 0) AS sv FROM doe, m) SELECT face, pos_id, round(sum(sv), 6) AS damage FROM v GROUP BY 1, 2")
def composite_damage(s, d):
    return rounded(D.composite_damage(T.doe(s, d), {"peak_g": 0.7, "peak_stress": 0.3}))


@query(f"""WITH {T.TRAJECTORIES}, ru AS (SELECT run_id AS pos_id, min(t) FILTER (contact_engaged) AS tc, arg_min(pos_z, t) AS z0, bool_or(contact_engaged) AS hit FROM trajectories GROUP BY 1),
  pk AS (SELECT user_id AS pos_id, event_id % 6 AS part_id, arg_min(event_id * 0.001::DOUBLE, (-value, event_id)) AS tp FROM events GROUP BY 1, 2),
  sa AS (SELECT part_id, tp - tc AS delay, sqrt(pow(pos_id % 7 * 400.0::DOUBLE - part_id * 300.0::DOUBLE, 2) + pow(pos_id % 5 * 800.0::DOUBLE - part_id * 200.0::DOUBLE, 2) + pow(z0 - part_id, 2)) / (tp - tc) / 1000 AS v FROM pk JOIN ru USING (pos_id) WHERE hit AND tp > tc)
  SELECT part_id, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(avg(delay), 6) AS mean_delay, count(*) AS samples FROM sa WHERE v > 0 AND v <= 12000 GROUP BY 1""")
def wave_speeds(s, d):
    """Of parts by runs that touch: the distance from the impact over the delay of the part's peak."""
    tr, on = T.trajectories(s, d), F.col("contact_engaged")
    runs = tr.groupBy(F.col("run_id").alias("pos_id")).agg(F.min(F.when(on, F.col("t"))).alias("t_contact"), F.min_by("pos_z", "t").alias("z"), F.when(F.bool_or(on), "contact").otherwise("no-contact").alias("behavior"))
    pos, part = F.col("pos_id"), F.col("part_id")
    e = T.read(s, d, "events").select(F.col("user_id").alias("pos_id"), (F.col("event_id") % 6).alias("part_id"), "event_id", "value")
    peaks = e.groupBy("pos_id", "part_id").agg(F.min_by(F.col("event_id") * 0.001, F.struct(-F.col("value"), "event_id")).alias("t_peak")).select("*", (part * 300.0).alias("x"), (part * 200.0).alias("y"), part.cast("double").alias("z"))
    positions = runs.select("pos_id", (pos % 7 * 400.0).alias("x"), (pos % 5 * 800.0).alias("y"))
    return rounded(D.wave_speed(peaks, runs, positions))


@query("SELECT name, CASE substr(name, 1, 1) WHEN 'F' THEN 'face' WHEN 'E' THEN 'edge' WHEN 'C' THEN 'corner' WHEN 'P' THEN 'fibonacci' ELSE 'unknown' END AS kind FROM (SELECT upper(substr(p_name, 1 + (p_partkey % 3)::INTEGER)) || '_' || p_partkey AS name FROM part UNION ALL SELECT n_name FROM nation)")
def angle_categories(s, d):
    """By the first letter of names made from those of parts and nations."""
    part = T.read(s, d, "part").select(F.concat(F.upper(F.substring(F.col("p_name"), (1 + F.col("p_partkey") % 3).cast("int"), F.length("p_name"))), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    names = part.union(T.read(s, d, "nation").select("n_name"))
    return names.select("name", D.angle_category(F.col("name")).alias("kind"))


@query(f"""WITH {T.DOE}, c AS (SELECT *, pow(peak_g / 1000 - 20, 2) + pow(peak_stress - 20, 2) AS a, pow(peak_g / 1000 - 80, 2) + pow(peak_stress - 45, 2) AS b, pow(peak_g / 1000 - 50, 2) + pow(peak_stress - 10, 2) AS c FROM doe)
  SELECT face, pos_id, part_id, CASE least(a, b, c) WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS cluster, round(least(a, b, c), 4) AS distance2 FROM c""")
def cluster_assignment(s, d):
    own = T.doe(s, d).withColumn("g", F.col("peak_g") / 1000)
    return rounded(D.assign_clusters(own, ["g", "peak_stress"], [[20.0, 20.0], [80.0, 45.0], [50.0, 10.0]]).select("face", "pos_id", "part_id", "cluster", "distance2"), 4)


@query(f"WITH {T.DOE}, m AS (SELECT max(abs(peak_g)) AS a, max(abs(peak_stress)) AS b FROM doe) SELECT count(*) AS n, round(max(a), 4) AS scale_0, round(max(b), 4) AS scale_1, round(sum(peak_g / a), 4) AS sum_0, round(sum(peak_stress / b), 4) AS sum_1, round(sum(peak_g / a * peak_g / a), 4) AS product_0_0, round(sum(peak_g / a * peak_stress / b), 4) AS product_0_1, round(sum(peak_stress / b * peak_stress / b), 4) AS product_1_1 FROM doe, m")
def scatter_of_scaled_metrics(s, d):
    return rounded(D.scatter_matrix(T.doe(s, d), ["peak_g", "peak_stress"]), 4)


@query(f"WITH {T.POINTS} SELECT face, a.point_id, round(sum(b.value / greatest((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 1e-18)) / sum(1 / greatest((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 1e-18)), 3) AS estimate FROM pts a JOIN pts b USING (face) WHERE a.point_id <> b.point_id GROUP BY 1, 2")
def leave_one_out_by_face(s, d):
    return rounded(D.leave_one_out(T.points(s, d), "point_id", "value", by=("face",)).select("face", "point_id", "estimate"), 3)


@query(f"""WITH {T.POINTS}, p AS (SELECT DISTINCT face % 5 AS g, x, y FROM pts), c AS (SELECT a.g, a.x, a.y, b.x AS bx, b.y AS by_, min(CASE WHEN (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) > 0 OR ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) = 0 AND (c.x-a.x)*(b.x-a.x) + (c.y-a.y)*(b.y-a.y) BETWEEN 0 AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) THEN 1 ELSE 0 END) AS ok
  FROM p a JOIN p b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.g = a.g GROUP BY 1, 2, 3, 4, 5), n AS (SELECT g, count(*) AS n FROM p GROUP BY 1) SELECT DISTINCT c.g, x, y FROM c JOIN n ON n.g = c.g AND n.n > 2 WHERE ok = 1""")
def hull_corners(s, d):
    own = T.points(s, d).withColumn("g", F.col("face") % 5)
    return D.convex_hull(own, "g").select("g", "x", "y")


@query("""WITH side AS (SELECT unnest([0, 1]) AS k), e AS (SELECT DISTINCT k, trim(regexp_replace(lower(event_type || ' ' || props), '[-+]?[0-9]+(\\.[0-9]+)?', '#', 'g')) AS m, event_type || ' ' || props AS title, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS sev FROM events, side WHERE (k = 0 AND ts < TIMESTAMP '2024-01-08') OR (k = 1 AND ts >= TIMESTAMP '2024-01-04')),
  r AS (SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY title, sev) AS i FROM e), o AS (SELECT * FROM r WHERE k = 0), n AS (SELECT * FROM r WHERE k = 1)
  SELECT CASE WHEN o.title IS NULL THEN 'new' WHEN n.title IS NULL THEN 'resolved' WHEN o.title <> n.title OR o.sev <> n.sev THEN 'changed' ELSE 'kept' END AS change, coalesce(n.title, o.title) AS title FROM o FULL JOIN n ON o.m = n.m AND o.i = n.i""")
def findings_difference_all(s, d):
    """All findings of two overlapping weeks: several of one mask are told apart."""
    e = T.read(s, d, "events").select("ts", F.concat_ws(" ", "event_type", "props").alias("title"), F.when(F.col("value") > 100, "high").otherwise("low").alias("severity"))
    return C.findings_diff(e.where("ts < timestamp_ntz'2024-01-08'"), e.where("ts >= timestamp_ntz'2024-01-04'"))


@query(f"WITH {T.CELLS}, p AS (SELECT rev, max(g) AS a FROM cells GROUP BY 1), r AS (SELECT rev, max(v) AS b FROM (SELECT rev, category, avg(g) AS v FROM cells GROUP BY 1, 2) GROUP BY 1) SELECT rev, round(a, 4) AS true_peak, round(b, 4) AS resampled_peak, round((b - a) / abs(a) * 100, 4) AS peak_damping_pct FROM p LEFT JOIN r USING (rev)")
def peak_damping_of_resampling(s, d):
    """Resampled here to the means of categories."""
    raw = T.cells(s, d)
    return rounded(C.peak_damping(raw, raw.groupBy("rev", "category").agg(F.avg("g").alias("g")), "g"), 4)


@query(f"WITH {T.CELLS} SELECT rev, key, 'order' AS fault FROM cells WHERE g < s3 * 60")
def order_faults(s, d):
    return C.order_faults(T.cells(s, d).withColumn("low", F.col("s3") * 60), "g", "low")

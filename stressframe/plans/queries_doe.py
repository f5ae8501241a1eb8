"""Queries of statistics over designs of experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import doe as D
from ..operators import sphere as Sp
from . import tables as T
from .registry import query, rounded

W = f"WITH {T.DOE}"


@query(f"{W} SELECT part_id, count(peak_g) AS n, round(max(peak_g), 4) AS max, round(quantile_cont(peak_g, 0.95), 4) AS p95, round(quantile_cont(peak_g, 0.5), 4) AS p50, round(quantile_cont(peak_g, 0.25), 4) AS p25, round(avg(peak_g), 4) AS mean, round(stddev_pop(peak_g), 4) AS sd, round(stddev_pop(peak_g) / avg(peak_g), 4) AS cov FROM doe GROUP BY 1")
def doe_part_statistics(s, d):
    return rounded(D.summary(T.doe(s, d), "peak_g", ("part_id",)), 4)


@query(f"{W} SELECT face, count(peak_stress) AS n, round(max(peak_stress), 4) AS max, round(avg(peak_stress), 4) AS mean FROM doe GROUP BY 1")
def doe_face_statistics(s, d):
    return rounded(D.summary(T.doe(s, d), "peak_stress", ("face",)).select("face", "n", "max", "mean"), 4)


@query(f"{W}, m AS (SELECT max(peak_g) AS g, max(peak_stress) AS st, max(peak_disp) AS dp FROM doe) SELECT face, pos_id, part_id, round((0.5 * peak_g / g + 0.3 * peak_stress / st + 0.2 * peak_disp / dp) / 1.0, 5) AS severity FROM doe, m")
def doe_severity(s, d):
    out = D.severity(T.doe(s, d), {"peak_g": 0.5, "peak_stress": 0.3, "peak_disp": 0.2})
    return rounded(out.select("face", "pos_id", "part_id", "severity"), 5)


@query(f"{W} SELECT part_id, count(*) FILTER (peak_g > 60000) AS influenced, round(avg(CASE WHEN peak_g > 60000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM doe GROUP BY 1")
def doe_influence_area(s, d):
    return rounded(D.influence(T.doe(s, d), "peak_g", 60000, ("part_id",)))


@query(f"WITH {T.POINTS} SELECT face, round(sum(value * x) / sum(value), 5) AS cx, round(sum(value * y) / sum(value), 5) AS cy FROM pts WHERE value > 0 GROUP BY 1")
def weighted_centroids(s, d):
    return rounded(D.weighted_centroid(T.points(s, d), "value", ("face",)), 5)


@query(f"""WITH {T.EV}, m AS (SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median FROM ev GROUP BY 1 HAVING count(value) >= 8), a AS (SELECT ev.*, median, abs(value - median) AS dv FROM ev JOIN m USING (event_type)), k AS (SELECT event_type, list_sort(list(dv))[count(dv) // 2 + 1] AS mad FROM a GROUP BY 1),
  z AS (SELECT event_id, event_type, 0.6745 * (value - median) / mad AS z FROM a JOIN k USING (event_type) WHERE mad > 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(z) DESC, event_id) AS n FROM z WHERE abs(z) > 1.2) SELECT event_id, event_type, round(z, 5) AS z FROM r WHERE n <= 10""")
def robust_outliers(s, d):
    e = T.event_series(s, d).select("event_id", "event_type", "value")
    return rounded(D.robust_outliers(e, "value", "event_type", 1.2).select("event_id", "event_type", "z"), 5)


@query(f"""{W}, q AS (SELECT part_id, quantile_cont(peak_g, 0.25) AS q1, quantile_cont(peak_g, 0.75) AS q3 FROM doe GROUP BY 1 HAVING count(peak_g) >= 4) SELECT face, pos_id, part_id, CASE WHEN peak_g > q3 + 1.0 * (q3 - q1) THEN 'high' ELSE 'low' END AS side FROM doe JOIN q USING (part_id) WHERE peak_g < q1 - 1.0 * (q3 - q1) OR peak_g > q3 + 1.0 * (q3 - q1)""")
def tukey_fences(s, d):
    return D.tukey(T.doe(s, d), "peak_g", "part_id", 1.0).select("face", "pos_id", "part_id", "side")


@query(f"""{W}, m AS (SELECT part_id, quantile_cont(peak_g, 0.5) AS median FROM doe GROUP BY 1), a AS (SELECT doe.*, median, abs(peak_g - median) AS dv FROM doe JOIN m USING (part_id)), k AS (SELECT part_id, quantile_cont(dv, 0.5) AS mad FROM a GROUP BY 1) SELECT face, pos_id, part_id, round(CASE WHEN mad > 0 THEN 0.6745 * (peak_g - median) / mad END, 4) AS z, coalesce(abs(CASE WHEN mad > 0 THEN 0.6745 * (peak_g - median) / mad END) > 2.5, false) AS anomalous FROM a JOIN k USING (part_id)""")
def anomaly_table(s, d):
    return rounded(D.anomalies(T.doe(s, d), "peak_g", "part_id", 2.5).select("face", "pos_id", "part_id", "z", "anomalous"), 4)


@query(f"""{W}, t AS (SELECT part_id FROM doe GROUP BY 1 ORDER BY max(peak_g) DESC, part_id LIMIT 12), o AS (SELECT part_id, face, pos_id, max(peak_g) AS v FROM doe JOIN t USING (part_id) GROUP BY 1, 2, 3) SELECT a.part_id AS a, b.part_id AS b, round(corr(a.v, b.v), 4) AS r, count(*) AS n FROM o a JOIN o b ON a.face = b.face AND a.pos_id = b.pos_id AND a.part_id < b.part_id GROUP BY 1, 2""")
def part_correlations(s, d):
    return rounded(D.correlations(T.doe(s, d), "part_id", ["face", "pos_id"], "peak_g"), 4)


@query(f"WITH {T.EV}, f AS (SELECT user_id % 20 AS run_id, event_type AS part_id, min(event_id) AS t FROM ev WHERE value > 80 GROUP BY 1, 2) SELECT part_id, round(avg(t), 4) AS mean, round(stddev_pop(t), 4) AS sd, count(*) AS n FROM f GROUP BY 1 ORDER BY mean, part_id LIMIT 12")
def time_of_arrival(s, d):
    e = T.event_series(s, d).select((F.col("user_id") % 20).alias("run_id"), F.col("event_type").alias("part_id"), F.col("event_id").alias("t"), "value")
    return rounded(D.arrival(e, "value", 80), 4)


@query(f"""WITH {T.POINTS}, b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM pts), g AS (SELECT i.i, j.j, ax + (bx - ax) * i.i / 30 AS gx, ay + (by_ - ay) * j.j / 30 AS gy FROM b, range(0, 31) i(i), range(0, 31) j(j))
  SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(value / greatest((x-gx)*(x-gx) + (y-gy)*(y-gy), 1e-18)) / sum(1 / greatest((x-gx)*(x-gx) + (y-gy)*(y-gy), 1e-18)), 3) AS value FROM pts, g GROUP BY 1, 2""")
def idw_surface(s, d):
    return rounded(D.idw_surface(T.points(s, d), "value"), 3)


@query(f"WITH {T.POINTS} SELECT a.point_id, round(a.value, 3) AS value, round(sum(b.value / greatest((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 1e-18)) / sum(1 / greatest((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 1e-18)), 3) AS estimate FROM pts a JOIN pts b ON a.point_id <> b.point_id GROUP BY a.point_id, a.value")
def idw_leave_one_out(s, d):
    return rounded(D.leave_one_out(T.points(s, d), "point_id", "value"), 3)


@query(f"""{W}, q AS (SELECT quantile_cont(peak_g, 0.75) AS q FROM doe), a AS (SELECT part_id, avg(peak_g) FILTER (peak_g > q) AS severity, avg(CASE WHEN peak_g > q THEN 1.0 ELSE 0.0 END) AS coverage FROM doe, q GROUP BY 1) SELECT part_id, round(severity, 4) AS severity, round(coverage, 6) AS coverage, severity > coalesce(max(severity) OVER (ORDER BY coverage DESC, severity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS front FROM a WHERE severity IS NOT NULL""")
def pareto_front(s, d):
    out = D.pareto(T.doe(s, d), "peak_g")
    return out.select("part_id", F.round(F.col("severity") + 3.1e-10, 4).alias("severity"), F.round(F.col("coverage") + 3.1e-10, 6).alias("coverage"), "front")


@query(f"""WITH {T.EV}, l AS (SELECT user_id % 10 AS run_id, event_type AS part_id, arg_max(value, event_id) AS ke, arg_max(value * 0.5, event_id) AS ie FROM ev GROUP BY 1, 2) SELECT run_id, part_id, round(ke / sum(ke + ie) OVER (PARTITION BY run_id), 5) AS ke_share, round(ie / sum(ke + ie) OVER (PARTITION BY run_id), 5) AS ie_share FROM l""")
def energy_partition(s, d):
    e = T.event_series(s, d).select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("part_id"), F.col("event_id").alias("t"), F.col("value").alias("ke"), (F.col("value") * 0.5).alias("ie"))
    return rounded(D.energy_partition(e).select("run_id", "part_id", "ke_share", "ie_share"), 5)


RISK = f"{W}, p AS (SELECT part_id, max(peak_g) / 1000 AS peak_stress FROM doe GROUP BY 1), y AS (SELECT p_brand AS part_id, max(p_retailprice) / 15 AS yield_stress FROM part WHERE p_brand NOT LIKE '%3' GROUP BY 1)"


def _risk(s, d):
    peaks = T.doe(s, d).groupBy("part_id").agg((F.max("peak_g") / 1000).alias("peak_stress"))
    yields = T.read(s, d, "part").where("p_brand not like '%3'").groupBy(F.col("p_brand").alias("part_id")).agg((F.max("p_retailprice") / 15).alias("yield_stress"))
    return peaks, yields


@query(f"{RISK}, j AS (SELECT part_id, peak_stress, yield_stress / peak_stress AS safety FROM p LEFT JOIN y USING (part_id)) SELECT part_id, round(safety, 5) AS safety, CASE WHEN safety IS NULL THEN 'unknown' WHEN safety < 1 THEN 'fail' WHEN safety < 1.5 THEN 'risk' ELSE 'ok' END AS level, CASE WHEN safety IS NULL THEN rank() OVER (PARTITION BY safety IS NULL ORDER BY peak_stress DESC)::INTEGER END AS fallback_rank FROM j")
def failure_risk(s, d):
    return rounded(D.failure_risk(*_risk(s, d)).select("part_id", "safety", "level", "fallback_rank"), 5)


@query(f"{W}, y AS (SELECT p_brand AS part_id, 30 + min(p_size) AS yield_stress FROM part GROUP BY 1) SELECT face, pos_id, round(sum(greatest(peak_stress / yield_stress - 1, 0)), 5) AS damage FROM doe JOIN y USING (part_id) GROUP BY 1, 2")
def damage_index(s, d):
    yields = T.read(s, d, "part").groupBy(F.col("p_brand").alias("part_id")).agg((F.min("p_size") + 30).cast("double").alias("yield_stress"))
    return rounded(D.damage(T.doe(s, d), "peak_stress", yields), 5)


@query(f"""WITH {T.POINTS}, r AS (SELECT point_id, face % 5 AS face, x, y, value FROM pts), b AS (SELECT face, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM r GROUP BY 1), n AS (SELECT r.*, least(x - ax, bx - x, y - ay, by_ - y) <= 0.15 * least(bx - ax, by_ - ay) AS near FROM r JOIN b USING (face))
  SELECT face, round(avg(value) FILTER (near), 4) AS edge, round(avg(value) FILTER (NOT near), 4) AS inside FROM n GROUP BY 1""")
def boundary_effect(s, d):
    p = T.points(s, d).withColumn("face", F.col("face") % 5)
    return rounded(D.boundary_effect(p, "value").select("face", "edge", "inside"), 4)


@query(f"{W}, q AS (SELECT quantile_cont(peak_g, 0.95) AS g, quantile_cont(peak_stress, 0.95) AS st, quantile_cont(peak_disp, 0.95) AS dp FROM doe), c AS (SELECT face, pos_id, part_id, 0.4 * peak_g / g + 0.4 * peak_stress / st + 0.2 * peak_disp / dp AS score FROM doe, q) SELECT face, pos_id, part_id, round(score, 5) AS score FROM c ORDER BY c.score DESC, face, pos_id, part_id LIMIT 25")
def worst_combinations(s, d):
    out = D.worst_combinations(T.doe(s, d), {"peak_g": 0.4, "peak_stress": 0.4, "peak_disp": 0.2})
    return rounded(out.select("face", "pos_id", "part_id", "score"), 5)


@query(f"WITH {T.POINTS} SELECT face, point_id AS pos_id, max(value) AS worst FROM pts GROUP BY 1, 2, x, y HAVING max(value) <= 5000")
def safe_zone(s, d):
    p = T.points(s, d).withColumnRenamed("point_id", "pos_id")
    return D.safe_zone(p, "value", 5000).select("face", "pos_id", "worst")


@query()
def convex_hulls(s, d):
    """Hulls of each face's points; tests compare them with known shapes."""
    return D.convex_hull(T.points(s, d).withColumn("face", F.col("face") % 5), "face")


@query()
def k_means_clusters(s, d):
    """Clusters depend on the library's start; tests compare separated groups."""
    return D.k_means(T.doe(s, d), ["peak_g", "peak_stress", "peak_disp"], 4).select("face", "pos_id", "part_id", "cluster")


@query()
def principal_modes(s, d):
    """Modes of the metrics; tests compare them with a direct decomposition."""
    names = ["peak_g", "peak_stress", "peak_strain", "peak_disp"]
    modes, shares = D.principal_components(T.doe(s, d), names)
    rows = [(i, n, float(v), float(shares[i])) for i, m in enumerate(np.asarray(modes)) for n, v in zip(names, m, strict=True)]
    return s.createDataFrame(rows, "mode int, metric string, weight double, share double")


#: Directions of suppliers: a latitude and a longitude; and the cosine of the angle between two.
WAYS = f"{T.POINTS}, c AS (SELECT point_id AS i, y * 2 AS roll, x * 3 AS pitch, value, face FROM pts)"
COSINE = "greatest(least(cos(radians(a.roll))*cos(radians(a.pitch))*cos(radians(b.roll))*cos(radians(b.pitch)) + cos(radians(a.roll))*sin(radians(a.pitch))*cos(radians(b.roll))*sin(radians(b.pitch)) + sin(radians(a.roll))*sin(radians(b.roll)), 1), -1)"


def _ways(s, d):
    return T.points(s, d).select(F.col("point_id").alias("i"), (F.col("y") * 2).alias("roll"), (F.col("x") * 3).alias("pitch"), "value", "face")


@query(f"WITH {WAYS}, n AS (SELECT a.i, min(degrees(acos({COSINE}))) AS ang FROM c a JOIN c b ON a.i <> b.i GROUP BY 1) SELECT round(avg(ang), 4) AS mean_nearest, round(max(ang), 4) AS largest_gap, round(least(pow(degrees(sqrt(4 * pi() / count(*))) / avg(ang), 2), 1), 4) AS coverage FROM n")
def sphere_coverage(s, d):
    return rounded(Sp.coverage(_ways(s, d)), 4)


@query(f"""WITH {WAYS}, n AS (SELECT count(*) AS n FROM c), g0 AS (SELECT i, degrees(asin(1 - (2 * i + 1) / n)) AS roll, (i * degrees(pi() * (3 - sqrt(5)))) % 360 AS turn FROM n, range((SELECT n FROM n)) t(i)), g AS (SELECT i, round(roll, 6) AS roll, round(CASE WHEN turn > 180 THEN turn - 360 ELSE turn END, 6) AS pitch FROM g0),
  p AS (SELECT a.i, b.i AS other, b.value, degrees(acos({COSINE})) AS ang FROM g a, c b), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(ang, 9), other) AS k FROM p)
  SELECT i, CASE WHEN min(ang) <= 0.001 THEN 'exact' ELSE 'idw' END AS source, CASE WHEN min(ang) <= 0.001 THEN 0 ELSE round(round(min(ang), 6), 4) END AS offset_deg, round(CASE WHEN min(ang) <= 0.001 THEN max(value) FILTER (k = 1) ELSE sum(value / pow(greatest(ang, 1e-9), 2)) / sum(1 / pow(greatest(ang, 1e-9), 2)) END, 4) AS value FROM r WHERE k <= 4 GROUP BY 1""")
def even_grid_interpolation(s, d):
    """Values of suppliers as directions, on an even grid of as many."""
    ways = _ways(s, d)
    return rounded(Sp.interpolate(Sp.even_grid(s, ways.count()), "i", ways, "i", "value").withColumnRenamed("offset", "offset_deg"), 4)


@query(f"{RISK}, g AS (SELECT part_id, max(peak_g) AS peak_g FROM doe GROUP BY 1) SELECT part_id, CASE WHEN yield_stress / peak_stress < 1 THEN 'critical' WHEN yield_stress / peak_stress < 1.5 OR peak_g > 90000 THEN 'warning' ELSE 'info' END AS severity FROM p LEFT JOIN y USING (part_id) JOIN g USING (part_id)")
def sphere_findings(s, d):
    peaks, yields = _risk(s, d)
    g = T.doe(s, d).groupBy("part_id").agg(F.max("peak_g").alias("peak_g"))
    return D.sphere_findings(peaks.join(yields, "part_id", "left").join(g, "part_id"), 90000.0).select("part_id", "severity")

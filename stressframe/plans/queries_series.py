"""Queries of time series, joins and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from ..operators import series as S
from . import tables as T
from .registry import near, query, rounded


@query(f"""WITH {T.EV}, s AS (SELECT *, coalesce((t - lag(t) OVER w) * (value + lag(value) OVER w) / 2, 0) AS p FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))
  SELECT event_id, round(sum(p) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 2) AS integral FROM s""")
def cumulative_trapezoid(s, d):
    return rounded(S.trapezoid(T.event_series(s, d), "user_id", "t", "value").select("event_id", "integral"), 2)


@query(f"""WITH {T.EV}, s AS (SELECT user_id, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 AS p FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(coalesce(sum(p), 0), 2) AS impulse FROM s GROUP BY 1""")
def trapezoid_impulse(s, d):
    return rounded(S.impulse(T.event_series(s, d), "user_id", "t", "value"), 2)


@query(f"""WITH {T.EV}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, t) AS p, count(*) OVER (PARTITION BY user_id) AS c FROM ev) SELECT event_id FROM s WHERE (n - 1) % 4 = 0 OR p = 1 OR n = c""")
def downsample_with_peak(s, d):
    return S.downsample(T.event_series(s, d), "user_id", "t", "value", 4).select("event_id")


@query(f"WITH {T.EV} SELECT user_id, round(max(abs(value)), 6) AS peak, round(arg_min(t, (-abs(value), t)), 3) AS t_peak FROM ev GROUP BY 1")
def true_peak(s, d):
    out = S.true_peak(T.event_series(s, d), "user_id", "t", "value")
    return out.select("user_id", near(F.col("peak"), 6).alias("peak"), near(F.col("t_peak"), 3).alias("t_peak"))


@query(f"""WITH {T.EV}, l AS (SELECT * FROM ev WHERE event_id % 2 = 0), r AS (SELECT * FROM ev WHERE event_id % 2 = 1)
  SELECT event_id, (SELECT round(arg_min(value, t), 6) FROM r WHERE r.user_id = l.user_id AND r.t >= l.t) AS value_as_of FROM l""")
def as_of_join(s, d):
    e = T.event_series(s, d)
    left, right = e.where("event_id % 2 = 0").select("event_id", "user_id", "t"), e.where("event_id % 2 = 1")
    return rounded(J.as_of(left, right, "user_id", "t", "value").select("event_id", "value_as_of"))


@query(f"""WITH {T.EV}, l AS (SELECT event_id, user_id, t FROM ev WHERE event_id % 2 = 0), r AS (SELECT * FROM ev WHERE event_id % 2 = 1),
  b AS (SELECT l.user_id, l.t, (SELECT max(r.t) FROM r WHERE r.user_id = l.user_id AND r.t <= l.t) AS t0, (SELECT min(r.t) FROM r WHERE r.user_id = l.user_id AND r.t >= l.t) AS t1 FROM l),
  v AS (SELECT b.*, a.value AS v0, c.value AS v1 FROM b LEFT JOIN r a ON a.user_id = b.user_id AND a.t = b.t0 LEFT JOIN r c ON c.user_id = b.user_id AND c.t = b.t1)
  SELECT user_id, round(t, 3) AS t, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) AS value FROM v""")
def linear_interpolation(s, d):
    e = T.event_series(s, d)
    out = J.interpolate(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "t", "value")
    return out.select("user_id", near(F.col("t"), 3).alias("t"), near(F.col("value"), 4).alias("value"))


@query(f"""WITH {T.POINTS}, l AS (SELECT * FROM pts WHERE point_id % 2 = 0), r AS (SELECT * FROM pts WHERE point_id % 2 = 1), p AS (SELECT l.point_id, r.point_id AS b, sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)) AS dist FROM l JOIN r ON true WHERE sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)) <= 12)
  SELECT l.point_id, m.b AS other_nearest, round(m.dist, 6) AS distance FROM l LEFT JOIN (SELECT point_id, arg_min(b, (dist, b)) AS b, min(dist) AS dist FROM p GROUP BY 1) m ON l.point_id = m.point_id""")
def nearest_within_radius(s, d):
    p = T.points(s, d).withColumn("g", F.lit(0))
    left, right = p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1").withColumnRenamed("point_id", "other")
    return rounded(J.nearest_within(left, right, 12.0, ["g"], "point_id", "other").select("point_id", "other_nearest", "distance"))


@query(f"""WITH {T.POINTS}, l AS (SELECT * FROM pts WHERE point_id % 4 = 0), r AS (SELECT * FROM pts WHERE point_id % 4 <> 0), p AS (SELECT l.point_id, r.value, sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)) AS dist, row_number() OVER (PARTITION BY l.point_id ORDER BY sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)), r.point_id) AS n FROM l JOIN r ON true)
  SELECT point_id, round(coalesce(max(value) FILTER (dist < 1e-9), sum(value / (dist*dist)) FILTER (dist >= 1e-9) / sum(1 / (dist*dist)) FILTER (dist >= 1e-9)), 4) AS value FROM p WHERE n <= 4 GROUP BY 1""")
def inverse_distance_weighting(s, d):
    p = T.points(s, d)
    out = J.idw(p.where("point_id % 4 = 0").select("point_id", "x", "y"), p.where("point_id % 4 <> 0").select("point_id", "x", "y", "value"), "point_id", "value")
    return rounded(out, 4)


@query(f"WITH {T.POINTS} SELECT a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON round(a.x, 4) = round(-b.x, 4) AND abs(round(a.y/20) - round(b.y/20)) < 0.5 AND a.point_id < b.point_id")
def mirror_pairs(s, d):
    p = T.points(s, d).select("point_id", "x", F.round(F.col("y") / 20).alias("y"))
    return J.mirror_pairs(p, "point_id", "x")


@query(f"""WITH {T.POINTS}, c AS (SELECT point_id, y * 2 AS roll, x * 3 AS pitch FROM pts), a(name, r, p) AS (VALUES ('front', 0.0::DOUBLE, 0.0::DOUBLE), ('right', 0.0, 90.0), ('back', 0.0, 180.0), ('left', 0.0, -90.0), ('top', 90.0, 0.0), ('bottom', -90.0, 0.0)),
  q AS (SELECT point_id, name, degrees(acos(greatest(least(cos(radians(roll))*cos(radians(pitch))*cos(radians(r))*cos(radians(p)) + cos(radians(roll))*sin(radians(pitch))*cos(radians(r))*sin(radians(p)) + sin(radians(roll))*sin(radians(r)), 1), -1))) AS ang FROM c JOIN a ON true) SELECT point_id, arg_min(name, (round(ang, 9), name)) AS nearest, round(min(ang), 4) AS angle FROM q GROUP BY 1""")
def angular_nearest(s, d):
    """Roll is the latitude and pitch the longitude of a direction."""
    c = T.points(s, d).select("point_id", (F.col("y") * 2).alias("roll"), (F.col("x") * 3).alias("pitch"))
    a = s.createDataFrame([("front", 0.0, 0.0), ("right", 0.0, 90.0), ("back", 0.0, 180.0), ("left", 0.0, -90.0), ("top", 90.0, 0.0), ("bottom", -90.0, 0.0)], "name string, roll double, pitch double")
    return rounded(J.angular_nearest(c, a, "name").select("point_id", "nearest", "angle"), 4)


@query("""WITH a AS (SELECT DISTINCT p_brand || ' ' || p_size AS left_name FROM part WHERE p_size < 20), b AS (SELECT DISTINCT upper(p_brand) || '_' || p_size AS right_name FROM part WHERE p_size > 10),
  n AS (SELECT left_name, trim(regexp_replace(lower(left_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM a), m AS (SELECT right_name, trim(regexp_replace(lower(right_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM b) SELECT left_name, right_name FROM n FULL JOIN m USING (k)""")
def part_name_matching(s, d):
    p = T.read(s, d, "part")
    left = p.where("p_size < 20").select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"))
    right = p.where("p_size > 10").select(F.concat(F.upper("p_brand"), F.lit("_"), F.col("p_size").cast("string")).alias("name"))
    return J.match_names(left, right, s.createDataFrame([], "left_name string, right_name string"))


EDGES = "ed AS (SELECT 's' || l_suppkey AS src, 'b' || p_brand AS dst, sum(l_quantity) AS impulse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {EDGES}, b1 AS (SELECT dst AS id FROM ed WHERE src = 's1' AND impulse > 0), s2 AS (SELECT DISTINCT src AS id FROM ed WHERE dst IN (SELECT id FROM b1) AND src <> 's1'), b3 AS (SELECT DISTINCT dst AS id FROM ed WHERE src IN (SELECT id FROM s2) AND dst NOT IN (SELECT id FROM b1)) SELECT 's1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM s2 UNION ALL SELECT id, 3 FROM b3")
def graph_depths(s, d):
    return G.depths(T.edges(s, d), s.createDataFrame([("s1",)], "id string"))


@query(f"""WITH RECURSIVE {EDGES}, bo AS (SELECT src, dst, 1 / (impulse + 1e-12) AS w FROM ed UNION ALL SELECT dst, src, 1 / (impulse + 1e-12) FROM ed),
  r1 AS (SELECT 's1' AS id, 0.0::DOUBLE AS c), r2 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r1 UNION ALL SELECT dst, c + w FROM r1 JOIN bo ON id = src) GROUP BY 1), r3 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r2 UNION ALL SELECT dst, c + w FROM r2 JOIN bo ON id = src) GROUP BY 1),
  r4 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r3 UNION ALL SELECT dst, c + w FROM r3 JOIN bo ON id = src) GROUP BY 1), r5 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r4 UNION ALL SELECT dst, c + w FROM r4 JOIN bo ON id = src) GROUP BY 1), r6 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r5 UNION ALL SELECT dst, c + w FROM r5 JOIN bo ON id = src) GROUP BY 1), r7 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r6 UNION ALL SELECT dst, c + w FROM r6 JOIN bo ON id = src) GROUP BY 1), r8 AS (SELECT id, min(c) AS c FROM (SELECT * FROM r7 UNION ALL SELECT dst, c + w FROM r7 JOIN bo ON id = src) GROUP BY 1)
  SELECT id, round(c, 6) AS cost FROM r8""")
def cheapest_energy_paths(s, d):
    return rounded(G.cheapest_paths(T.edges(s, d), s.createDataFrame([("s1",)], "id string")).select("id", "cost"))


@query(f"""WITH {T.EV}, c AS (SELECT user_id, event_type, t, value, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 AS i FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)) SELECT user_id AS src, event_type AS dst, round(sum(i), 2) AS impulse, round(max(value), 6) AS peak_force FROM c GROUP BY 1, 2""")
def energy_flow_edges(s, d):
    c = T.event_series(s, d).select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "t", F.col("value").alias("force"), F.lit(1.0).alias("velocity"))
    out = G.flow_edges(c)
    return out.select("src", "dst", near(F.col("impulse"), 2).alias("impulse"), near(F.col("peak_force"), 6).alias("peak_force"))


@query(f"WITH {T.EV} SELECT user_id AS src, event_type AS dst, round(min(t), 3) AS t_engaged FROM ev WHERE abs(value) > 50 GROUP BY 1, 2")
def first_engagement(s, d):
    c = T.event_series(s, d).select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "t", F.col("value").alias("force"))
    return rounded(G.first_engaged(c, 50.0), 3)


@query()
def dominant_frequency(s, d):
    """Spectra need a transform; tests compare it with known sines."""
    return S.dominant_frequency(T.event_series(s, d), "user_id", "t", "value")


@query()
def shock_response_spectrum(s, d):
    e = T.event_series(s, d).select("user_id", (F.col("t") / 1e6).alias("t"), "value")
    return S.shock_spectrum(e, "user_id", "t", "value")

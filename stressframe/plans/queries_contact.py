"""Queries of contacts, trajectories and energy audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contact as K
from ..operators import doe as D
from ..operators import graph as G
from ..operators import joins as J
from ..operators import series as S
from . import tables as T
from .registry import query, rounded

MASK = f"""WITH {T.FORCES}, f AS (SELECT run_id, interface_id || '/' || side AS s, t, abs(fx) + abs(fy) + abs(fz) AS f FROM forces a WHERE side = -1 OR NOT EXISTS (SELECT 1 FROM forces b WHERE b.run_id = a.run_id AND b.side = -1)),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id, s ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY run_id, s) AS n FROM f),
  l AS (SELECT run_id, s, min(t) AS t0, max(t) AS t1, greatest(0.1 * max(f), 5 * max(f) FILTER (i = greatest(1, n // 5) // 2)) AS lim, max(f) AS peak FROM r GROUP BY 1, 2),
  clock AS (SELECT DISTINCT user_id % 3 AS run_id, event_id * 0.001::DOUBLE + 0.0004 AS t FROM events WHERE event_id % 4 = 0)"""


def _clock(s, d):
    return T.read(s, d, "events").where("event_id % 4 = 0").select((F.col("user_id") % 3).cast("int").alias("run_id"), (F.col("event_id") * 0.001 + 0.0004).alias("t")).distinct()


@query(f"""{MASK}, hit AS (SELECT DISTINCT c.run_id, c.t FROM clock c JOIN l ON c.run_id = l.run_id AND l.peak > 0 AND c.t BETWEEN l.t0 AND l.t1 ASOF JOIN f ON f.run_id = c.run_id AND f.s = l.s AND c.t <= f.t WHERE f.f > l.lim)
  SELECT c.run_id::INTEGER AS run_id, round(c.t, 4) AS t, h.t IS NOT NULL AS engaged FROM clock c LEFT JOIN hit h ON c.run_id = h.run_id AND c.t = h.t""")
def contact_mask(s, d):
    return rounded(K.contact_mask(T.forces(s, d), _clock(s, d)), 4)


METRICS = f"""{T.FORCES}, f AS (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS f FROM forces),
  q AS (SELECT *, (t - lag(t) OVER w) * (f + lag(f) OVER w) / 2 AS step, max(f) OVER (PARTITION BY run_id, interface_id, side) AS own FROM f WINDOW w AS (PARTITION BY run_id, interface_id, side ORDER BY t)),
  e AS (SELECT run_id, interface_id, side, max(f) AS peak, min(t) FILTER (f = own) AS t_peak, coalesce(sum(step), 0) AS impulse, min(t) FILTER (own > 0 AND f >= 0.01 * own) AS t_first, max(t) FILTER (own > 0 AND f >= 0.01 * own) AS t_last, count(*) AS samples FROM q GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY run_id, interface_id ORDER BY side >= 0 DESC, peak DESC, side) AS n, count(*) FILTER (side >= 0) OVER (PARTITION BY run_id, interface_id) AS sides FROM e),
  p AS (SELECT run_id, interface_id, max(peak) FILTER (side = 0) AS xp, max(impulse) FILTER (side = 0) AS xi, max(peak) FILTER (side = 1) AS yp, max(impulse) FILTER (side = 1) AS yi FROM e GROUP BY 1, 2),
  metrics AS (SELECT run_id, interface_id, side AS side_used, peak AS peak_force, t_peak, impulse, t_first AS t_engaged, t_last AS t_released, samples, sides, coalesce(least(xp, yp) < 0.01 * greatest(xp, yp) AND xp IS NOT NULL AND yp IS NOT NULL, false) AS one_sided,
    CASE WHEN xp IS NOT NULL AND yp IS NOT NULL AND least(xp, yp) >= 0.01 * greatest(xp, yp) THEN CASE WHEN greatest(xi, yi) = 0 THEN 0 ELSE abs(xi - yi) / greatest(xi, yi) END END AS balance FROM b JOIN p USING (run_id, interface_id) WHERE n = 1)"""


@query(f"WITH {METRICS} SELECT run_id, interface_id, side_used, round(peak_force, 6) AS peak_force, round(t_peak, 6) AS t_peak, round(impulse, 4) AS impulse, round(t_engaged, 6) AS t_engaged, round(t_released, 6) AS t_released, samples, sides, one_sided, round(balance, 6) AS balance FROM metrics")
def contact_force_metrics(s, d):
    out = K.contact_metrics(T.forces(s, d))
    return rounded(out.withColumn("impulse", F.round(F.col("impulse") + 3.1e-10, 4)))


@query(f"""WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, balance IS NULL ORDER BY balance, interface_id) - 1 AS i, count(balance) OVER (PARTITION BY run_id) AS n FROM metrics)
  SELECT run_id, count(balance) AS checked, count(*) FILTER (one_sided OR sides < 2) AS one_sided, round(max(balance), 6) AS max_balance, round(max(balance) FILTER (balance IS NOT NULL AND i = n // 2), 6) AS median_balance, count(t_engaged) AS engaged,
    round(min(t_engaged), 6) AS first_engaged, round(min(t_peak) FILTER (peak_force > 0), 6) AS first_peak, round(max(t_peak) FILTER (peak_force > 0), 6) AS last_peak, round(CASE WHEN count(*) FILTER (peak_force > 0) > 1 THEN max(t_peak) FILTER (peak_force > 0) - min(t_peak) FILTER (peak_force > 0) END, 6) AS peak_spread FROM r GROUP BY 1""")
def contact_consistency_checks(s, d):
    return rounded(K.contact_checks(K.contact_metrics(T.forces(s, d))))


SUMMARY = f"""{T.TRAJECTORIES}, tc AS (SELECT *, sqrt(vel_x*vel_x + vel_y*vel_y + vel_z*vel_z) AS speed, min(t) FILTER (contact_engaged) OVER (PARTITION BY run_id) AS tc FROM trajectories),
  sm AS (SELECT run_id, min(tc) AS t_contact, coalesce(max(ke) FILTER (ke > 0 AND (tc IS NULL OR t <= tc)), arg_min(ke, t)) AS ke_before, arg_max(ke, t) AS ke_after, max(speed) FILTER (tc IS NULL OR t <= tc) AS incident_speed, arg_max(speed, t) AS rebound_speed, arg_max(vel_x, t) AS last_vx, arg_max(vel_y, t) AS last_vy, arg_max(vel_z, t) AS last_vz,
    arg_min(vel_z, t) FILTER (abs(vel_z) > 1e-12) AS first_vz, greatest(coalesce(max(pos_z) FILTER (t = tc), arg_min(pos_z, t)) - min(pos_z), 0) AS depth FROM tc GROUP BY 1),
  summary AS (SELECT *, CASE WHEN ke_before > 0 THEN ke_after / ke_before ELSE 0 END AS ke_retention FROM sm),
  classed AS (SELECT *, CASE WHEN coalesce(incident_speed, 0) <= 0 THEN 'unknown' WHEN ke_retention >= 0.995 AND (t_contact IS NULL OR (last_vz * coalesce(sign(first_vz), -1) > 0 AND abs(last_vz) / incident_speed >= 0.9)) THEN 'no-contact'
    WHEN ke_retention >= 0.4 AND abs(last_vz) / incident_speed >= 0.05 THEN 'bounce' WHEN ke_retention < 0.15 AND abs(last_vz) / incident_speed < 0.01 THEN 'embed' WHEN sqrt(last_vx*last_vx + last_vy*last_vy) > abs(last_vz) AND ke_retention >= 0.15 THEN 'slide' ELSE 'rebound' END AS behavior FROM summary)"""


def _summary(s, d):
    return K.trajectory_summary(T.trajectories(s, d))


@query(f"WITH {SUMMARY} SELECT run_id, round(t_contact, 6) AS t_contact, round(ke_before, 6) AS ke_before, round(ke_after, 6) AS ke_after, round(incident_speed, 6) AS incident_speed, round(rebound_speed, 6) AS rebound_speed, round(last_vx, 6) AS last_vx, round(last_vy, 6) AS last_vy, round(last_vz, 6) AS last_vz, round(first_vz, 6) AS first_vz, round(depth, 6) AS depth, round(ke_retention, 6) AS ke_retention FROM summary")
def trajectory_summaries(s, d):
    return rounded(_summary(s, d))


@query(f"WITH {SUMMARY} SELECT run_id, behavior FROM classed")
def impact_behavior(s, d):
    return K.behavior(_summary(s, d)).select("run_id", "behavior")


@query(f"WITH {SUMMARY} SELECT run_id, round(CASE WHEN ke_before > 0 THEN sqrt(ke_after / ke_before) END, 6) AS restitution FROM summary")
def restitution(s, d):
    return rounded(K.restitution(_summary(s, d)).select("run_id", "restitution"))


PLACES = "places AS (SELECT s_suppkey AS run_id, (s_suppkey * 37) % 101 - 50.0::DOUBLE AS x, (s_suppkey * 53) % 83 - 40.0::DOUBLE AS y FROM supplier)"


def _places(s, d):
    n = F.col("s_suppkey")
    return T.read(s, d, "supplier").select(n.alias("run_id"), ((n * 37) % 101 - 50.0).alias("x"), ((n * 53) % 83 - 40.0).alias("y"))


@query(f"""WITH {SUMMARY}, {PLACES}, r AS (SELECT p.*, last_vx AS vx, last_vy AS vy, last_vz AS vz, sqrt(last_vx*last_vx + last_vy*last_vy) AS speed, greatest(0.05 * abs(incident_speed), 0.1) AS lim FROM places p LEFT JOIN summary USING (run_id)), m AS (SELECT max(speed) AS top FROM r)
  SELECT run_id, round(x, 6) AS x, round(y, 6) AS y, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz, round(speed, 6) AS speed, CASE WHEN vz > lim THEN 'up' WHEN vz < -lim THEN 'down' WHEN vz IS NOT NULL THEN 'flat' END AS course, speed > greatest(abs(vz), 1e-6) AND speed > 0.05 * greatest(top, 1e-6) AS sliding FROM r, m""")
def rebound_field(s, d):
    return rounded(K.rebound_field(_places(s, d), _summary(s, d)))


@query(f"""WITH {T.TRAJECTORIES}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM trajectories),
  k AS (SELECT DISTINCT run_id, round_even(unnest(range(12)) * ((n - 1) / 11.0::DOUBLE), 0)::BIGINT AS i FROM (SELECT DISTINCT run_id, n FROM n WHERE n > 12))
  SELECT run_id, round(t, 6) AS t, round(pos_x, 6) AS pos_x, round(pos_y, 6) AS pos_y, round(pos_z, 6) AS pos_z FROM n WHERE n <= 12 OR i = n - 1 OR (run_id, i) IN (SELECT (run_id, i) FROM k)""")
def trajectory_bundles(s, d):
    return rounded(K.trajectory_bundles(T.trajectories(s, d), 12).select("run_id", "t", "pos_x", "pos_y", "pos_z"))


@query(f"""WITH {SUMMARY}, {PLACES}, pk AS (SELECT user_id AS run_id, event_type AS part_id, max(event_id) * 0.001::DOUBLE AS t_peak, max(value) AS peak_g FROM events GROUP BY 1, 2)
  SELECT p.run_id, part_id, round(x, 6) AS x, round(y, 6) AS y, behavior, round(t_contact, 6) AS t_contact, round(t_peak, 6) AS t_peak, round(t_peak - t_contact, 6) AS delay, round(CASE WHEN part_id <> 'view' THEN peak_g END, 6) AS peak_g FROM places p JOIN classed c ON p.run_id = c.run_id AND t_contact IS NOT NULL JOIN pk ON pk.run_id = p.run_id""")
def positions_with_trajectories_and_motion(s, d):
    own = T.read(s, d, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("part_id")).agg((F.max("event_id") * 0.001).alias("t_peak"), F.max("value").alias("peak_g"))
    motion = own.where("part_id <> 'view'").select("run_id", "part_id", "peak_g")
    return rounded(K.along_trajectory(motion, K.behavior(_summary(s, d)), _places(s, d), own.select("run_id", "part_id", "t_peak")).select("run_id", "part_id", "x", "y", "behavior", "t_contact", "t_peak", "delay", "peak_g"))


@query(f"""WITH e AS (SELECT l_suppkey AS run_id, CASE WHEN p_size % 9 = 0 THEN 'wall' ELSE (p_size % 5)::VARCHAR END AS src, (p_size % 4)::VARCHAR AS dst, max(l_extendedprice) AS peak_force, sum(l_quantity) AS impulse, sum(l_tax) AS work FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 3 = 0 GROUP BY 1, 2, 3),
  pos AS (SELECT s_suppkey AS run_id FROM supplier WHERE s_suppkey % 2 = 0), o AS (SELECT *, src || '>' || dst AS pair, regexp_full_match(src, '[0-9]+') AND regexp_full_match(dst, '[0-9]+') AS resolved FROM e WHERE run_id IN (SELECT run_id FROM pos)),
  p AS (SELECT pair, resolved, row_number() OVER (ORDER BY resolved DESC, max(peak_force) DESC, pair) AS place FROM o GROUP BY 1, 2)
  SELECT p.pair, place, p.resolved, pos.run_id, round(peak_force, 6) AS peak_force, round(impulse, 6) AS impulse, round(work, 6) AS work FROM p CROSS JOIN pos LEFT JOIN o ON o.pair = p.pair AND o.run_id = pos.run_id""")
def contact_pair_profile(s, d):
    rows = T.read(s, d, "lineitem").where("l_suppkey % 3 = 0").join(T.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    src = F.when(F.col("p_size") % 9 == 0, "wall").otherwise((F.col("p_size") % 5).cast("string"))
    edges = rows.groupBy(F.col("l_suppkey").alias("run_id"), src.alias("src"), (F.col("p_size") % 4).cast("string").alias("dst")).agg(F.max("l_extendedprice").alias("peak_force"), F.sum("l_quantity").alias("impulse"), F.sum("l_tax").alias("work"))
    return rounded(K.contact_profile(edges, T.read(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("run_id"))))


@query(f"""WITH {T.ENERGIES}, a AS (SELECT run_id, arg_min(ke, t) AS ke0, arg_max(ke, t) AS ke1, arg_min(total, t) AS te0, arg_max(total, t) AS te1, max(ke) AS hi, min(ke) AS lo, max(ie) AS ie, max(hourglass) AS hg, max(abs(sliding)) AS sl FROM energies GROUP BY 1),
  b AS (SELECT *, coalesce((hi - lo) / nullif(CASE WHEN ke0 > 0 THEN ke0 ELSE hi END, 0) >= 0.005, false) AS impact_visible, ke0 > 0 AND ie >= 0.001 * ke0 AS internal_significant FROM a),
  p AS (SELECT run_id, impact_visible, internal_significant, CASE WHEN impact_visible AND ke0 > 0 THEN round(greatest(100 * (ke0 - ke1) / ke0, 0), 2) END AS dissipated_pct, CASE WHEN te0 > 0 THEN round(abs(te1 - te0) / te0 * 100, 4) END AS drift_pct,
    CASE WHEN ie > 0 THEN round(100 * hg / ie, 2) END AS hourglass_pct, CASE WHEN ke0 > 0 THEN round(100 * sl / ke0, 2) END AS sliding_pct FROM b),
  l AS (SELECT *, CASE WHEN drift_pct >= 5 THEN 'fail' WHEN drift_pct >= 2 THEN 'warn' WHEN drift_pct IS NOT NULL THEN 'pass' END AS drift_level, CASE WHEN NOT internal_significant THEN NULL WHEN hourglass_pct >= 20 THEN 'fail' WHEN hourglass_pct >= 10 THEN 'warn' WHEN hourglass_pct IS NOT NULL THEN 'pass' END AS hourglass_level,
    CASE WHEN sliding_pct >= 10 THEN 'fail' WHEN sliding_pct >= 5 THEN 'warn' WHEN sliding_pct IS NOT NULL THEN 'pass' END AS sliding_level FROM p)
  SELECT *, CASE WHEN list_contains([drift_level, hourglass_level, sliding_level], 'fail') THEN 'fail' WHEN list_contains([drift_level, hourglass_level, sliding_level], 'warn') THEN 'warn' WHEN list_contains([drift_level, hourglass_level, sliding_level], 'pass') THEN 'pass' ELSE 'unknown' END AS verdict FROM l""")
def energy_balance_audit(s, d):
    return rounded(S.energy_audit(T.energies(s, d)))


@query(f"""WITH {T.ENERGIES}, e AS (SELECT run_id, arg_min(ke + ie + hourglass + sliding, t) AS first, arg_max(ke + ie + hourglass + sliding, t) AS last FROM energies GROUP BY 1) SELECT run_id, round(first, 6) AS first, round(last, 6) AS last, round(last - first, 6) AS residual, round(CASE WHEN first <> 0 THEN (last - first) / abs(first) * 100 END, 6) AS residual_pct FROM e""")
def energy_conservation_residual(s, d):
    return rounded(G.energy_residual(T.energies(s, d)))


@query(f"""WITH {SUMMARY}, r AS (SELECT run_id, t, pos_z, contact_engaged AS e FROM trajectories WHERE run_id NOT IN (SELECT run_id FROM classed WHERE behavior = 'no-contact')),
  g AS (SELECT run_id, min(t) FILTER (e) AS t_start, max(t) FILTER (e) AS t_end, count(*) FILTER (e) AS contact_steps, count(*) AS n, arg_min(pos_z, t) FILTER (e) AS z0 FROM r GROUP BY 1),
  k AS (SELECT run_id, arg_min(t, (-abs(pos_z - z0), t)) AS t_deep FROM r JOIN g USING (run_id) WHERE e GROUP BY 1)
  SELECT run_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(t_end - t_start, 6) AS duration, contact_steps, round(contact_steps / n, 6) AS density, round(t_deep - t_start, 6) AS to_peak FROM g LEFT JOIN k USING (run_id)""")
def contact_pulses(s, d):
    """Runs of the class without contact are left out."""
    runs = T.trajectories(s, d).withColumnRenamed("contact_engaged", "engaged")
    classes = K.behavior(_summary(s, d)).select("run_id", "behavior")
    return rounded(S.pulses(runs, "run_id", "t", "pos_z", classes))


MOTIONS = "mo AS (SELECT (user_id % 4)::INTEGER AS pos_id, (user_id // 4 % 40)::INTEGER AS part_id, event_id * 0.001::DOUBLE AS t, value AS acc FROM events)"


@query(f"""WITH {MOTIONS}, pk AS (SELECT pos_id, part_id, max(acc) AS peak, count(*) AS n, arg_min(t, (-acc, t)) AS t0 FROM mo GROUP BY 1, 2), worst AS (SELECT pos_id FROM pk GROUP BY 1 ORDER BY sum(peak) DESC, pos_id LIMIT 1),
  af AS (SELECT part_id, t, acc, peak, n, t0, acc - avg(acc) OVER (PARTITION BY part_id) AS c FROM mo JOIN pk USING (pos_id, part_id) JOIN worst USING (pos_id) WHERE t >= t0), sg AS (SELECT *, sign(c) <> lag(sign(c)) OVER (PARTITION BY part_id ORDER BY t) AS turn FROM af),
  g AS (SELECT part_id, max(peak) AS peak, max(n) AS n, count(*) AS m, max(t0) AS t0, min(t) FILTER (acc <= 0.05 * peak) AS tl, max(t) AS t1, arg_max(acc, t) AS last, count(*) FILTER (turn) AS zc FROM sg GROUP BY 1),
  q AS (SELECT *, n >= 8 AND m >= 6 AND peak > 0 AS ok, CASE WHEN tl > t0 THEN tl - t0 ELSE t1 - t0 END AS tau, CASE WHEN t1 > t0 AND zc >= 2 THEN 0.5 * zc / (t1 - t0) END AS f, CASE WHEN tl IS NOT NULL THEN 20 ELSE greatest(peak / greatest(last, 1e-30), 1 + 1e-9) END AS ratio FROM g)
  SELECT (SELECT pos_id FROM worst) AS pos_id, part_id, CASE WHEN ok THEN round(tau, 6) END AS recovery, CASE WHEN ok AND f > 0 AND tau > 0 THEN round(greatest(least(ln(ratio) / (2 * pi() * f * tau), 1), 0), 6) END AS damping, CASE WHEN ok THEN zc ELSE 0 END AS sign_changes, ok AS has_data FROM q""")
def recovery_and_damping(s, d):
    """Parts at the position with the largest sum of peaks."""
    u = F.col("user_id")
    motions = T.read(s, d, "events").select((u % 4).cast("int").alias("pos_id"), (F.floor(u / 4) % 40).cast("int").alias("part_id"), (F.col("event_id") * 0.001).alias("t"), F.col("value").alias("acc"))
    return rounded(S.recovery(motions))


@query(f"""WITH {T.POINTS}, n AS (SELECT a.face, a.point_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS dist FROM pts a JOIN pts b ON a.face = b.face AND a.point_id <> b.point_id GROUP BY 1, 2) SELECT face, round(quantile_cont(dist, 0.5), 6) AS spacing FROM n WHERE dist > 0 GROUP BY 1""")
def median_grid_spacing(s, d):
    return rounded(J.median_spacing(T.points(s, d).select("face", "point_id", "x", "y"), ["face"], "point_id"))


@query(f"""WITH {T.POINTS}, p AS (SELECT a.point_id, b.point_id AS other, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist FROM pts a JOIN pts b ON a.face % 4 = b.face % 4), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, other) AS rank FROM p)
  SELECT point_id, other, round(dist, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def five_nearest_points(s, d):
    p = T.points(s, d).withColumn("g", F.col("face") % 4)
    near = J.k_nearest(p, p.select("g", F.col("point_id").alias("__b"), F.col("x").alias("__x"), F.col("y").alias("__y")), "point_id", ["g"], 5)
    return rounded(near.select("point_id", F.col("__b").alias("other"), "distance", "rank"))


@query("""WITH p AS (SELECT l_suppkey AS id, min((l_partkey % 6))::INTEGER AS depth FROM lineitem GROUP BY 1), r AS (SELECT id, depth, 2 * pi() * (row_number() OVER (PARTITION BY depth ORDER BY id) - 1) / count(*) OVER (PARTITION BY depth) AS turn FROM p) SELECT id, depth, round(depth * 2.5 * cos(turn), 6) AS px, round(depth * 2.5 * sin(turn), 6) AS py FROM r""")
def ring_layout(s, d):
    found = T.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.min(F.col("l_partkey") % 6).cast("int").alias("depth"))
    return rounded(G.ring_layout(found, 2.5))


@query(f"""WITH {SUMMARY}, {T.DOE}, {T.ENERGIES}, yl AS (SELECT p_brand AS part_id, (20 + max(p_size)) * 1.0::DOUBLE AS ys FROM part GROUP BY 1),
  au AS (SELECT run_id, arg_min(ke, t) AS ke0, max(ke) AS hi, min(ke) AS lo, arg_min(total, t) AS te0, arg_max(total, t) AS te1, max(ie) AS ie, max(hourglass) AS hg, max(abs(sliding)) AS sl FROM energies GROUP BY 1),
  fa AS (SELECT (hi - lo) / (CASE WHEN ke0 > 0 THEN ke0 ELSE hi END) >= 0.005 AS seen, coalesce(round(abs(te1 - te0) / te0 * 100, 4) >= 5, false) OR coalesce(ie >= 0.001 * ke0 AND round(100 * hg / ie, 2) >= 20, false) OR coalesce(round(100 * sl / ke0, 2) >= 10, false) AS failed FROM au),
  me AS (SELECT pos_id, avg(peak_g) AS m FROM doe GROUP BY 1), si AS (SELECT avg(m) FILTER (x < 0) AS l, avg(m) FILTER (x > 0) AS r FROM me JOIN (SELECT s_suppkey AS pos_id, (s_suppkey::DOUBLE * 37) % 101 - 50 AS x FROM supplier) USING (pos_id)), asy AS (SELECT abs(l - r) / ((l + r) / 2) * 100 AS a FROM si),
  ab AS (SELECT (1 - avg(ke_retention)) * 100 AS a FROM classed WHERE behavior <> 'no-contact'), di AS (SELECT part_id, max(peak_stress / ys) AS d FROM doe JOIN yl USING (part_id) GROUP BY 1), dt AS (SELECT max(d) AS d, arg_min(part_id, (-d, part_id)) AS p FROM di),
  sp AS (SELECT count(*) AS n, avg(m) AS mu, stddev_pop(m) AS sd FROM me), ap AS (SELECT count(*) FILTER (abs((m - mu) / sd) > 2.5) AS k, max(n) AS n FROM me, sp WHERE sd > 0)
  SELECT 'runs without contact' AS rule, 'critical' AS severity, count(*)::DOUBLE AS metric, NULL::VARCHAR AS subject FROM fa WHERE NOT seen HAVING count(*) > 0 UNION ALL SELECT 'energy balance fails', 'critical', count(*), NULL FROM fa WHERE failed HAVING count(*) > 0
  UNION ALL SELECT 'largest response', 'critical', round(max(peak_g), 1), arg_min(pos_id || '/' || part_id, (-peak_g, pos_id, part_id)) FROM doe HAVING count(*) > 0
  UNION ALL SELECT 'asymmetry along x', CASE WHEN a < 30 THEN 'warning' ELSE 'critical' END, round(a, 1), NULL FROM asy WHERE a > 15
  UNION ALL SELECT 'energy absorption', CASE WHEN a < 30 THEN 'warning' ELSE 'info' END, round(a, 1), CASE WHEN a < 50 THEN 'low' ELSE 'enough' END FROM ab WHERE a IS NOT NULL
  UNION ALL SELECT 'share of the yield', CASE WHEN d >= 1 THEN 'critical' WHEN d >= 0.8 THEN 'warning' ELSE 'info' END, round(d, 2), p FROM dt WHERE d >= 0.6 UNION ALL SELECT 'positions apart', 'warning', k, NULL FROM ap WHERE k > 0 AND n >= 4""")
def recommendations(s, d):
    yields = T.read(s, d, "part").groupBy(F.col("p_brand").alias("part_id")).agg(((20 + F.max("p_size")) * F.lit(1.0)).alias("yield_stress"))
    places = T.points(s, d).select(F.col("point_id").alias("pos_id"), "x")
    return rounded(D.recommendations(T.doe(s, d), places, S.energy_audit(T.energies(s, d)), K.behavior(_summary(s, d)), yields))


@query(f"""WITH {SUMMARY}, {T.DOE}, li AS (SELECT avg(peak_g) AS g, quantile_cont(peak_stress, 0.75) AS st, quantile_cont(peak_disp, 0.75) AS di FROM doe),
  vi AS (SELECT face, pos_id, part_id, k, ['peak_g', 'peak_stress', 'peak_disp'][k + 1] AS metric, [peak_g, peak_stress, peak_disp][k + 1] AS v, [g, st, di][k + 1] AS lim FROM doe, li, range(3) t(k)),
  wo AS (SELECT face, pos_id, arg_min({{'m': metric, 'v': v, 'p': part_id}}, (-v / lim, part_id, k)) AS w FROM vi WHERE v > lim GROUP BY 1, 2), po AS (SELECT DISTINCT face, pos_id FROM doe), nc AS (SELECT run_id FROM classed WHERE behavior = 'no-contact')
  SELECT face, pos_id, CASE WHEN pos_id IN (SELECT run_id FROM nc) THEN 'no-contact' WHEN w IS NULL THEN 'safe' ELSE 'at-risk' END AS status, CASE WHEN pos_id NOT IN (SELECT run_id FROM nc) THEN w.m END AS worst_metric, CASE WHEN pos_id NOT IN (SELECT run_id FROM nc) THEN round(w.v, 6) END AS worst_value, CASE WHEN pos_id NOT IN (SELECT run_id FROM nc) THEN w.p END AS worst_part FROM po LEFT JOIN wo USING (face, pos_id)""")
def drop_zones(s, d):
    """Positions by three thresholds of their own; runs of the class without contact are no data."""
    classes = K.behavior(_summary(s, d)).select(F.col("run_id").alias("pos_id"), "behavior")
    return rounded(D.drop_zones(T.doe(s, d), classes))

"""Queries of revision comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import joins as J
from . import tables as T
from .registry import query, rounded

W = f"WITH {T.CELLS}"


@query(f"{W}, b AS (SELECT *, max(g) FILTER (rev = 0) OVER (PARTITION BY key) AS base FROM cells) SELECT rev, key, round(g, 4) AS g, round(base, 4) AS base, round(g - base, 4) AS delta, round(CASE WHEN base <> 0 THEN (g - base) / abs(base) * 100 END, 4) AS delta_pct FROM b")
def revision_deltas(s, d):
    return rounded(C.deltas(T.cells(s, d), "g", 0), 4)


@query(f"{W} SELECT key, round(min(g), 4) AS min, round(max(g), 4) AS max, round(max(g) - min(g), 4) AS range, round(stddev_pop(g), 4) AS sd, round(stddev_pop(g) / abs(avg(g)), 4) AS cv FROM cells GROUP BY 1")
def revision_spread(s, d):
    return rounded(C.spread(T.cells(s, d), "g"), 4)


@query(f"{W}, t AS (SELECT key, regr_slope(g, rev::DOUBLE) AS slope, max(g) FILTER (rev = 0) AS base FROM cells GROUP BY 1) SELECT key, round(slope, 4) AS slope, round(base, 4) AS base, round(CASE WHEN base <> 0 THEN slope / abs(base) END, 4) AS trend FROM t")
def revision_trend(s, d):
    return rounded(C.trend(T.cells(s, d), "g", 0), 4)


@query(f"{W} SELECT key, arg_max(rev, (g, -rev)) AS worst_rev, round(max(g), 4) AS worst FROM cells GROUP BY 1")
def revision_winner(s, d):
    return rounded(C.winner(T.cells(s, d), "g"), 4)


@query(f"{W} SELECT key, arg_min(rev, (s3, rev)) AS worst_rev, round(min(s3), 4) AS worst FROM cells GROUP BY 1")
def compressive_winner(s, d):
    return rounded(C.winner(T.cells(s, d), "s3"), 4)


@query(f"{W} SELECT rev, key, round(CASE WHEN trust_ok THEN g END, 4) AS g FROM cells")
def trust_gate(s, d):
    return rounded(C.gate(T.cells(s, d), ["g"]).select("rev", "key", "g"), 4)


@query(f"{W}, w AS (SELECT rev, nation::VARCHAR AS part_name, max(g) AS worst FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rev ORDER BY worst DESC, part_name) AS rank FROM w) SELECT r.part_name, r.rev, round(r.worst, 4) AS worst, r.rank, b.rank AS base_rank, r.rank - b.rank AS rank_delta FROM r LEFT JOIN r b ON b.part_name = r.part_name AND b.rev = 0")
def part_ranks(s, d):
    cells = T.cells(s, d).withColumn("part_name", F.col("nation").cast("string"))
    out = rounded(C.rank_parts(cells, "g", 0), 4)
    return out.select("part_name", "rev", "worst", *(F.col(c).cast("long").alias(c) for c in ("rank", "base_rank", "rank_delta")))


@query(f"{W}, b AS (SELECT key, behavior AS f FROM cells WHERE rev = 0) SELECT rev, f AS from_behavior, behavior AS to_behavior, count(*) AS count FROM cells JOIN b USING (key) WHERE rev <> 0 GROUP BY 1, 2, 3")
def behavior_transitions(s, d):
    return C.transitions(T.cells(s, d), 0)


@query(f"{W}, a AS (SELECT category, rev, max(g) AS worst, quantile_cont(g, 0.5) AS median, avg(g) AS mean FROM cells GROUP BY 1, 2), b AS (SELECT *, max(worst) FILTER (rev = 0) OVER (PARTITION BY category) AS bw FROM a) SELECT category, rev, round(worst, 4) AS worst, round(median, 4) AS median, round(mean, 4) AS mean, round(CASE WHEN bw <> 0 THEN (worst - bw) / abs(bw) * 100 END, 4) AS worst_delta_pct FROM b")
def category_summary(s, d):
    return rounded(C.category_summary(T.cells(s, d), "g", 0), 4)


@query(f'{W} SELECT category, round(max(g) FILTER (rev = 0), 4) AS "0", round(max(g) FILTER (rev = 1), 4) AS "1", round(max(g) FILTER (rev = 2), 4) AS "2" FROM cells GROUP BY 1')
def category_matrix(s, d):
    return rounded(C.matrix(T.cells(s, d), "category", "rev", "g", [0, 1, 2]), 4)


@query(f"{W} SELECT category, rev, round(max(g), 4) AS worst FROM cells GROUP BY 1, 2 HAVING max(g) IS NOT NULL")
def category_matrix_long(s, d):
    """The matrix of all revisions of the table, a row for each filled place."""
    wide = C.matrix(T.cells(s, d), "category", "rev", "g")
    return rounded(wide.unpivot(["category"], wide.columns[1:], "rev", "worst").where("worst is not null").withColumn("rev", F.col("rev").cast("int")), 4)


@query(f"{W} SELECT key FROM cells GROUP BY 1 HAVING count(DISTINCT rev) = (SELECT count(DISTINCT rev) FROM cells)")
def keys_of_all_revisions(s, d):
    return C.common_keys(T.cells(s, d))


@query(f"{W}, p AS (SELECT rev, max(g) AS peak, count(*) AS n, count(*) FILTER (trust_ok) AS m FROM cells GROUP BY 1), b AS (SELECT peak AS bp FROM p WHERE rev = 0) SELECT rev, round(peak, 4) AS true_peak, round(CASE WHEN bp <> 0 THEN (peak - bp) / abs(bp) * 100 END, 4) AS peak_delta_pct, round(m * 100.0 / n, 4) AS comparable_pct FROM p, b")
def revision_kpis(s, d):
    raw = T.cells(s, d)
    return rounded(C.kpis(raw, C.gate(raw, ["g"]), "g", 0), 4)


FIND = """o AS (SELECT trim(regexp_replace(lower(substr(props, 1, 12)), '[-+]?[0-9]+(\\.[0-9]+)?', '#', 'g')) AS k, min(substr(props, 1, 12)) AS title, min(event_type) AS sev FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
n AS (SELECT trim(regexp_replace(lower(substr(props, 1, 12)), '[-+]?[0-9]+(\\.[0-9]+)?', '#', 'g')) AS k, min(substr(props, 1, 12)) AS title, min(event_type) AS sev FROM events WHERE event_id % 3 <> 1 GROUP BY 1)"""


@query(f"WITH {FIND} SELECT CASE WHEN o.title IS NULL THEN 'new' WHEN n.title IS NULL THEN 'resolved' WHEN o.title <> n.title OR o.sev IS DISTINCT FROM n.sev THEN 'changed' ELSE 'kept' END AS change, coalesce(n.title, o.title) AS title FROM o FULL JOIN n ON o.k = n.k")
def findings_difference(s, d):
    """One finding of each mask on either side; ``findings_difference_all`` has them all."""
    e = T.read(s, d, "events").select("event_id", F.substring("props", 1, 12).alias("title"), F.col("event_type").alias("severity"))
    one = lambda f: f.groupBy(C.masked(F.col("title")).alias("k")).agg(F.min("title").alias("title"), F.min("severity").alias("severity"))
    return C.findings_diff(one(e.where("event_id % 3 <> 0")), one(e.where("event_id % 3 <> 1")))


@query(f"{W}, m AS (SELECT max(abs(s3)) AS top FROM cells), t AS (SELECT rev, key, s3, abs(s3) <= 0.3 * top AS small FROM cells, m), r AS (SELECT avg(CASE WHEN small THEN 1.0 ELSE 0.0 END) AS rate FROM t) SELECT rev, key, round(s3, 4) AS s3 FROM t, r WHERE NOT (rate >= 0.2 AND small)")
def sparse_matrix(s, d):
    return rounded(C.drop_small(T.cells(s, d).select("rev", "key", "s3"), "s3", 0.3, 0.2), 4)


@query(f"{W} SELECT rev, key, CASE WHEN s3 = 0 THEN 0 ELSE round(round(s3 * pow(10.0, 3 - floor(log10(abs(s3)))), 0) / pow(10.0, 3 - floor(log10(abs(s3)))), 6) END AS s3 FROM cells")
def significant_figures(s, d):
    return rounded(T.cells(s, d).select("rev", "key", C.significant(F.col("s3") + 3.1e-10).alias("s3")))


@query(f"{W}, t AS (SELECT *, CASE WHEN g > 300000 THEN 0 WHEN g > 200000 THEN 1 ELSE 2 END AS tier FROM cells), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY g DESC, key) AS n FROM t) SELECT rev, key, tier FROM r WHERE n <= CASE tier WHEN 0 THEN 60 ELSE 20 END")
def tiered_sample(s, d):
    tier = F.when(F.col("g") > 300000, 0).when(F.col("g") > 200000, 1).otherwise(2)
    return C.tiers(T.cells(s, d).withColumn("tier", tier), "g", 100).select("rev", "key", "tier")


@query(f"{W} SELECT rev, round(min(g), 4) AS min, round(quantile_cont(g, 0.5), 4) AS median, round(max(g), 4) AS max, count(g) AS n FROM cells GROUP BY 1")
def metric_band(s, d):
    return rounded(C.band(T.cells(s, d), "g"), 4)


@query(f"WITH {T.POINTS}, a AS (SELECT point_id, list_sort([abs(x), abs(y), abs(z)]) AS v FROM pts) SELECT point_id, CASE WHEN v[3] >= (v[3] + v[2]) / sqrt(2) AND v[3] >= (v[3] + v[2] + v[1]) / sqrt(3) THEN 'face' WHEN (v[3] + v[2]) / sqrt(2) >= (v[3] + v[2] + v[1]) / sqrt(3) THEN 'edge' ELSE 'corner' END AS kind FROM a")
def direction_classes(s, d):
    return T.points(s, d).select("point_id", C.direction_class(F.col("x"), F.col("y"), F.col("z")).alias("kind"))


@query("SELECT p_partkey, round(p_retailprice * CASE p_size % 4 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e-2 WHEN 2 THEN 1 END, 6) AS metres FROM part")
def unit_conversion(s, d):
    label = F.element_at(F.array(*map(F.lit, ("mm", "cm", "m", "?"))), (F.col("p_size") % 4 + 1).cast("int"))
    return rounded(T.read(s, d, "part").select("p_partkey", C.convert(F.col("p_retailprice"), label, "m").alias("metres")))


@query("SELECT l_orderkey::INTEGER AS rev, l_linenumber::VARCHAR AS key, 'duplicate' AS fault FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT l_orderkey::INTEGER, l_linenumber::VARCHAR, 'negative' FROM lineitem WHERE l_quantity - 3 < 0")
def input_guards(s, d):
    rows = T.read(s, d, "lineitem").select(F.col("l_orderkey").cast("int").alias("rev"), F.col("l_linenumber").cast("string").alias("key"), (F.col("l_quantity") - 3).alias("g"))
    return C.guards(rows)


@query(f"{W}, c AS (SELECT *, nation::DOUBLE AS x, nation * 0.5::DOUBLE AS y FROM cells), b AS (SELECT category, round(x, 6) AS gx, round(y, 6) AS gy, key AS base_key FROM c WHERE rev = 0), o AS (SELECT rev, key, category, round(x, 6) AS gx, round(y, 6) AS gy FROM c WHERE rev <> 0) SELECT rev, key, base_key, category, gx, gy FROM o FULL JOIN b USING (category, gx, gy)")
def revision_alignment(s, d):
    c = T.cells(s, d).withColumns({"x": F.col("nation").cast("double") + 3.1e-10, "y": F.col("nation") * 0.5 + 3.1e-10})
    return J.align_exact(c, 0).select("rev", "key", "base_key", "category", "gx", "gy")

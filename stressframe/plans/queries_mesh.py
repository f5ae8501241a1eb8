"""Queries of mesh operators and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh as M
from ..operators import parts as P
from ..operators.select import Regions  # noqa: F401
from . import tables as T
from .registry import query, rounded

HEX = "[[1,4,3,2],[5,6,7,8],[1,2,6,5],[2,3,7,6],[3,4,8,7],[4,1,5,8]]"
FACES = f"""{T.SOLIDS}, f0 AS (SELECT elem_idx, elem_id, part_id, node_ids, unnest({HEX}) AS f FROM solids),
fc AS (SELECT elem_idx, elem_id, part_id, [node_ids[f[1]], node_ids[f[2]], node_ids[f[3]], node_ids[f[4]]] AS nodes FROM f0),
ext AS (SELECT min(elem_idx) AS elem_idx, min(elem_id) AS elem_id, min(part_id) AS part_id, min(nodes) AS nodes FROM fc GROUP BY list_sort(nodes) HAVING count(*) = 1)"""
GEO = f"""{FACES}, {T.NODES}, g0 AS (SELECT e.elem_idx, e.elem_id, e.part_id, e.nodes, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, d.x AS dx, d.y AS dy, d.z AS dz
  FROM ext e JOIN nodes a ON a.node_id = nodes[1] JOIN nodes b ON b.node_id = nodes[2] JOIN nodes c ON c.node_id = nodes[3] JOIN nodes d ON d.node_id = nodes[4]),
g1 AS (SELECT *, (cy-ay)*(dz-bz) - (cz-az)*(dy-by_) AS ux, (cz-az)*(dx-bx) - (cx-ax)*(dz-bz) AS uy, (cx-ax)*(dy-by_) - (cy-ay)*(dx-bx) AS uz FROM g0),
geo AS (SELECT elem_idx, elem_id, part_id, nodes, ux / sqrt(ux*ux+uy*uy+uz*uz) AS nx, uy / sqrt(ux*ux+uy*uy+uz*uz) AS ny, uz / sqrt(ux*ux+uy*uy+uz*uz) AS nz, (ax+bx+cx+dx)/4 AS mx, (ay+by_+cy+dy)/4 AS my, (az+bz+cz+dz)/4 AS mz FROM g1)"""


def _geometry(s, d):
    return M.face_geometry(M.with_corners(M.exterior_faces(T.solids(s, d)), T.nodes(s, d)))


@query(f"WITH {FACES} SELECT elem_idx, elem_id, part_id, nodes[1]::INTEGER AS n0, nodes[2]::INTEGER AS n1, nodes[3]::INTEGER AS n2, nodes[4]::INTEGER AS n3 FROM ext")
def exterior_faces(s, d):
    return M.exterior_faces(T.solids(s, d)).select("elem_idx", "elem_id", "part_id", *(F.get("nodes", F.lit(i)).alias(f"n{i}") for i in range(4)))


@query(f"""WITH {T.SOLIDS}, f0 AS (SELECT elem_idx, part_id, node_ids, unnest({HEX}) AS f FROM solids WHERE part_id IN (1, 2, 3)), fc AS (SELECT elem_idx, [node_ids[f[1]], node_ids[f[2]], node_ids[f[3]], node_ids[f[4]]] AS nodes FROM f0),
  e AS (SELECT min(elem_idx) AS elem_idx FROM fc GROUP BY list_sort(nodes) HAVING count(*) = 1) SELECT elem_idx, count(*) AS faces FROM e GROUP BY 1""")
def exterior_faces_of_parts(s, d):
    return M.exterior_faces(T.solids(s, d), [1, 2, 3]).groupBy("elem_idx").agg(F.count("*").alias("faces"))


@query(f"WITH {GEO} SELECT elem_idx, nodes[1]::INTEGER AS n0, nodes[3]::INTEGER AS n2, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(mx, 5) AS cx, round(my, 5) AS cy, round(mz, 5) AS cz FROM geo")
def face_normals_and_centroids(s, d):
    return rounded(_geometry(s, d).select("elem_idx", F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", F.lit(2)).alias("n2"), "nx", "ny", "nz", "cx", "cy", "cz"), 5)


@query(f"WITH {GEO} SELECT elem_idx, nodes[1]::INTEGER AS n0, nodes[3]::INTEGER AS n2 FROM geo WHERE nz >= cos(radians(45)) - 1e-12")
def surface_facing_up(s, d):
    return M.facing(_geometry(s, d), (0.0, 0.0, 1.0), 45.0).select("elem_idx", F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", F.lit(2)).alias("n2"))


@query(f"""WITH {GEO}, {T.ES}, up AS (SELECT * FROM geo WHERE nz >= cos(radians(45)) - 1e-12),
  b AS (SELECT state_idx, elem_id, {T.VM} AS vm, sxx*nx*nx + syy*ny*ny + szz*nz*nz + 2*(txy*nx*ny + tyz*ny*nz + tzx*nz*nx) AS nrm FROM up JOIN (SELECT es.* EXCLUDE (part_id), part_id AS sup FROM es) e ON e.sup = up.elem_idx)
  SELECT state_idx, round(max(vm), 5) AS vm_max, round(min(vm), 5) AS vm_min, round(avg(vm), 5) AS vm_avg, round(max(nrm), 5) AS normal_max, round(min(nrm), 5) AS normal_min, round(avg(nrm), 5) AS normal_avg FROM b GROUP BY 1""")
def surface_stress_statistics(s, d):
    up = M.facing(_geometry(s, d), (0.0, 0.0, 1.0), 45.0)
    states = T.element_states(s, d).withColumns({"etype": F.lit("SOLID"), "elem_idx": F.col("part_id").cast("int")})
    return rounded(M.surface_stress(up, states).select("state_idx", "vm_max", "vm_min", "vm_avg", "normal_max", "normal_min", "normal_avg"), 5)


LODE = "acos(greatest(least({j3} * 1.5 * sqrt(3) / pow({j2}, 1.5), 1), -1)) / 3"
SEVEN_SQL = ("von_mises", "principal_1", "principal_3", "effective_plastic_strain", "strain_principal_1", "strain_principal_3", "effective_strain")
FACE_SQL = ("von_mises", "principal_1", "principal_3", "normal_stress", "shear_stress")


def _principals(of: str, names: tuple[str, ...], source: str) -> str:
    """A table with the largest and the least principal value of six columns, and their von Mises strain."""
    xx, yy, zz, xy, yz, zx = names
    return f"""{of}0 AS (SELECT *, ({xx} + {yy} + {zz}) / 3 AS {of}m FROM {source}),
  {of}1 AS (SELECT *, (({xx}-{of}m)*({xx}-{of}m) + ({yy}-{of}m)*({yy}-{of}m) + ({zz}-{of}m)*({zz}-{of}m)) / 2 + {xy}*{xy} + {yz}*{yz} + {zx}*{zx} AS {of}j2, ({xx}-{of}m)*({yy}-{of}m)*({zz}-{of}m) + 2*{xy}*{yz}*{zx} - ({xx}-{of}m)*{yz}*{yz} - ({yy}-{of}m)*{zx}*{zx} - ({zz}-{of}m)*{xy}*{xy} AS {of}j3 FROM {of}0),
  {of}2 AS (SELECT *, CASE WHEN {of}j2 < 1e-20 THEN 0 ELSE {LODE.format(j3=f"{of}j3", j2=f"{of}j2")} END AS {of}th, CASE WHEN {of}j2 < 1e-20 THEN 0 ELSE 2 * sqrt({of}j2 / 3) END AS {of}r FROM {of}1),
  {of} AS (SELECT *, {of}m + {of}r * cos({of}th) AS {of}_1, {of}m + {of}r * cos({of}th + 2 * pi() / 3) AS {of}_3, sqrt(4 * {of}j2 / 3) AS {of}_vm FROM {of}2)"""


@query(f"""WITH {GEO}, {T.ES}, st0 AS (SELECT *, syy / 100 AS exx, sxx / 50 AS eyy, szz / 10 AS ezz, txy / 8 AS exy, tyz / 25 AS eyz, tzx / 5 AS ezx FROM es), {_principals("s", ("sxx", "syy", "szz", "txy", "tyz", "tzx"), "st0")}, {_principals("e", ("exx", "eyy", "ezz", "exy", "eyz", "ezx"), "s")},
  q AS (SELECT *, sqrt(3 * sj2) AS von_mises, s_1 AS principal_1, s_3 AS principal_3, eps AS effective_plastic_strain, e_1 AS strain_principal_1, e_3 AS strain_principal_3, e_vm AS effective_strain FROM e),
  fs AS (SELECT 'top' AS surface, elem_id, nx, ny, nz FROM geo WHERE nz >= cos(radians(45)) - 1e-12 UNION ALL SELECT 'bottom', elem_id, nx, ny, nz FROM geo WHERE -nz >= cos(radians(45)) - 1e-12),
  t AS (SELECT q.*, surface, sxx*nx + txy*ny + tzx*nz AS tx, txy*nx + syy*ny + tyz*nz AS ty, tzx*nx + tyz*ny + szz*nz AS tz, nx, ny, nz FROM q JOIN fs ON q.element_id = fs.elem_id),
  n AS (SELECT *, tx*nx + ty*ny + tz*nz AS normal_stress, sqrt(greatest(tx*tx + ty*ty + tz*tz - (tx*nx + ty*ny + tz*nz) * (tx*nx + ty*ny + tz*nz), 0)) AS shear_stress FROM t),
  u AS (SELECT 'part' AS kind, part_id::VARCHAR AS target, element_id, state_idx, unnest([{", ".join(f"'{c}'" for c in SEVEN_SQL)}]) AS quantity, unnest([{", ".join(SEVEN_SQL)}]) AS v FROM q
    UNION ALL SELECT 'surface', surface, element_id, state_idx, unnest([{", ".join(f"'{c}'" for c in FACE_SQL)}]), unnest([{", ".join(FACE_SQL)}]) FROM n)
  SELECT kind, target, state_idx, quantity, round(max(v), 4) AS max, round(min(v), 4) AS min, round(avg(v), 4) AS avg, arg_max(element_id, (round(v, 5), -element_id)) AS max_element, arg_min(element_id, (round(v, 5), element_id)) AS min_element FROM u GROUP BY 1, 2, 3, 4""")
def parts_and_faces_in_one_pass(s, d):
    """Stress and strain of parts, and stress on the faces that look up and down; the states are read once for each of the two."""
    geometry = _geometry(s, d)
    faces = None
    for name, way in (("top", 1.0), ("bottom", -1.0)):
        one = M.facing(geometry, (0.0, 0.0, way), 45.0).select(F.lit(name).alias("surface"), F.col("elem_id").cast("long").alias("element_id"), "nx", "ny", "nz")
        faces = one if faces is None else faces.union(one)
    strains = {"exx": F.col("syy") / 100, "eyy": F.col("sxx") / 50, "ezz": F.col("szz") / 10, "exy": F.col("txy") / 8, "eyz": F.col("tyz") / 25, "ezx": F.col("tzx") / 5}
    return rounded(P.parts_and_faces(T.element_states(s, d).withColumns(strains), faces, ties=5), 4)


@query(f"WITH {T.SOLIDS} SELECT DISTINCT unnest(node_ids)::INTEGER AS node_id, part_id FROM solids")
def node_part_mapping(s, d):
    return M.node_parts(T.solids(s, d))


@query(f"WITH {T.POINTS}, b AS (SELECT face, min(x) - 1 AS min_x, max(x) + 1 AS max_x, min(y) - 1 AS min_y, max(y) + 1 AS max_y, min(z) - 1 AS min_z, max(z) + 1 AS max_z FROM pts GROUP BY 1) SELECT *, round(sqrt((max_x-min_x)*(max_x-min_x) + (max_y-min_y)*(max_y-min_y) + (max_z-min_z)*(max_z-min_z)), 6) AS diagonal, (min_x+max_x)/2 AS centre_x, (min_y+max_y)/2 AS centre_y, (min_z+max_z)/2 AS centre_z FROM b")
def bounding_boxes(s, d):
    return rounded(M.bounding_box(T.points(s, d), ("face",), 1.0))


@query(f"WITH {T.POINTS}, b AS (SELECT min(x) AS l, max(x) AS h FROM pts) SELECT i::INTEGER AS section, round(l + (h - l) * i / 6, 6) AS position FROM b, range(1, 6) t(i)")
def section_positions(s, d):
    return rounded(M.section_positions(M.bounding_box(T.points(s, d)), "x", 5))


@query(f"""WITH {T.SOLIDS}, {T.ES}, v AS (SELECT part_id AS elem_idx, state_idx, avg(syy) AS v FROM es GROUP BY 1, 2), e AS (SELECT elem_idx, unnest(node_ids) AS node_id FROM solids)
  SELECT node_id::INTEGER AS node_id, state_idx, round(avg(v), 5) AS v FROM e JOIN v USING (elem_idx) GROUP BY 1, 2""")
def nodal_averages(s, d):
    values = T.element_states(s, d).groupBy(F.col("part_id").cast("int").alias("elem_idx"), "state_idx").agg(F.avg("syy").alias("v")).withColumn("etype", F.lit("SOLID"))
    return rounded(M.nodal_average(T.solids(s, d), values, "v"), 5)


@query(f"""WITH {T.EV}, g AS (SELECT user_id AS part_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INTEGER - 1 AS state_idx, t AS time, value AS mean_x FROM ev),
  v AS (SELECT *, time - lag(time) OVER w AS dt, CASE WHEN state_idx > 0 AND time > lag(time) OVER w THEN (mean_x - lag(mean_x) OVER w) / (time - lag(time) OVER w) ELSE 0 END AS velocity_mean_x FROM g WINDOW w AS (PARTITION BY part_id ORDER BY state_idx))
  SELECT part_id, state_idx, round(velocity_mean_x, 5) AS velocity_mean_x, round(CASE WHEN state_idx > 1 AND dt > 0 THEN (velocity_mean_x - lag(velocity_mean_x) OVER (PARTITION BY part_id ORDER BY state_idx)) / dt ELSE 0 END, 5) AS acceleration_mean_x FROM v""")
def motion_differences(s, d):
    from pyspark.sql.window import Window

    e = T.event_series(s, d)
    g = e.select(F.col("user_id").alias("part_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).cast("int").alias("state_idx"), F.col("t").alias("time"), F.col("value").alias("mean_x"))
    return rounded(P.differences(g, ["mean_x"]).select("part_id", "state_idx", "velocity_mean_x", "acceleration_mean_x"), 5)


@query(f"""WITH {T.SOLIDS}, {T.NODES}, np AS (SELECT DISTINCT unnest(node_ids) AS node_id, part_id FROM solids), m AS (SELECT node_id, t AS state_idx, t * 0.01 AS time, x * 0.1 * t AS ux, y * -0.05 * t AS uy, z * 0.02 * t AS uz FROM nodes, range(0, 4) r(t))
  SELECT part_id, state_idx::INTEGER AS state_idx, round(avg(ux), 5) AS mean_x, round(avg(uy), 5) AS mean_y, round(avg(uz), 5) AS mean_z, round(max(sqrt(ux*ux + uy*uy + uz*uz)), 5) AS max_displacement FROM m JOIN np USING (node_id) GROUP BY 1, 2""")
def part_motion(s, d):
    n = T.nodes(s, d).withColumn("state_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    t = F.col("state_idx")
    moved = n.select("node_id", "state_idx", (t * 0.01).alias("time"), (F.col("x") * (1 + 0.1 * t)).alias("x"), (F.col("y") * (1 - 0.05 * t)).alias("y"), (F.col("z") * (1 + 0.02 * t)).alias("z"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    return rounded(P.motion(moved, M.node_parts(T.solids(s, d))).select("part_id", "state_idx", "mean_x", "mean_y", "mean_z", "max_displacement"), 5)


CORNERS = ", ".join(f"max(x) FILTER (i = {i}) AS x{i}, max(y) FILTER (i = {i}) AS y{i}, max(z) FILTER (i = {i}) AS z{i}" for i in range(1, 9))


def _edge(a, b):
    return f"sqrt((x{b}-x{a})*(x{b}-x{a}) + (y{b}-y{a})*(y{b}-y{a}) + (z{b}-z{a})*(z{b}-z{a}))"


def _tet(a, b, c, d):
    u, v, w = ([f"({k}{n}-{k}{a})" for k in "xyz"] for n in (b, c, d))
    return f"(({u[1]}*{v[2]}-{u[2]}*{v[1]})*{w[0]} + ({u[2]}*{v[0]}-{u[0]}*{v[2]})*{w[1]} + ({u[0]}*{v[1]}-{u[1]}*{v[0]})*{w[2]})"


_E = ", ".join(_edge(a + 1, b + 1) for a, b in M.HEXA_EDGES)
_V = " + ".join(_tet(*(i + 1 for i in t)) for t in ((0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6)))
_J = ", ".join(f"{_tet(i + 1, a + 1, b + 1, c + 1)} / ({_edge(i + 1, a + 1)} * {_edge(i + 1, b + 1)} * {_edge(i + 1, c + 1)})" for i, (a, b, c) in enumerate(M.CORNERS))


@query(f"""WITH {T.SOLIDS}, {T.NODES}, e AS (SELECT elem_id, part_id, unnest(node_ids) AS node_id, unnest(range(1, 9)) AS i FROM solids), p AS (SELECT elem_id, part_id, {CORNERS} FROM e JOIN nodes USING (node_id) GROUP BY 1, 2)
  SELECT elem_id, part_id, round(greatest({_E}) / least({_E}), 5) AS aspect, round(({_V}) / 6, 5) AS volume, round(least({_J}), 5) AS jacobian FROM p""")
def element_quality(s, d):
    faces = T.solids(s, d).withColumnRenamed("node_ids", "nodes")
    each = faces.select("elem_id", "part_id", F.posexplode("nodes").alias("i", "node_id")).join(T.nodes(s, d).select("node_id", F.struct("x", "y", "z").alias("p")), "node_id")
    corners = each.groupBy("elem_id", "part_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("m")).select("elem_id", "part_id", F.lit(0).alias("state_idx"), *(F.col("m")[i].alias(f"p{i}") for i in range(8)))
    return rounded(M.element_quality(corners).select("elem_id", "part_id", "aspect", "volume", "jacobian"), 5)


def _degenerate(kind):
    """Corners of a tetrahedron (the last is repeated), a pyramid (its top is) and a wedge, in place of eight."""
    return {1: (0, 1, 2, 4, 4, 4, 4, 4), 2: (0, 1, 2, 3, 4, 4, 4, 4), 3: (0, 1, 2, 3, 4, 4, 7, 7)}.get(kind, tuple(range(8)))


_DEG = " ".join(f"WHEN {k} THEN [{', '.join(f'node_ids[{i + 1}]' for i in _degenerate(k))}]" for k in (1, 2, 3))


@query(f"""WITH {T.SOLIDS}, {T.NODES}, so AS (SELECT elem_id, part_id, CASE elem_idx % 5 {_DEG} WHEN 4 THEN list_reverse(node_ids) ELSE node_ids END AS node_ids FROM solids), e AS (SELECT elem_id, part_id, len(list_distinct(node_ids)) AS u, unnest(node_ids) AS node_id, unnest(range(1, 9)) AS i FROM so), p AS (SELECT elem_id, part_id, u, {CORNERS} FROM e JOIN nodes USING (node_id) GROUP BY 1, 2, 3),
  q AS (SELECT elem_id, part_id, u, greatest({_E}) AS hi, least({_E}) AS lo, CASE WHEN u = 4 THEN {_tet(1, 2, 3, 4)} / 6 ELSE ({_V}) / 6 END AS volume, CASE WHEN u = 8 THEN least({_J}) END AS jacobian FROM p)
  SELECT elem_id, part_id, round(CASE WHEN lo > hi * 1e-9 THEN hi / lo END, 5) AS aspect, round(volume, 5) AS volume, round(jacobian, 5) AS jacobian, CASE WHEN u = 8 THEN jacobian < 0 ELSE volume < 0 END AS inverted FROM q""")
def degenerate_quality(s, d):
    """Solids with fewer corners, and some turned over: volume by their own kind, a Jacobian only of eight corners."""
    n = F.col("node_ids")
    turn = F.col("elem_idx") % 5
    shape = F.when(turn == 4, F.reverse(n))
    for k in (1, 2, 3):
        shape = shape.when(turn == k, F.array(*(n[i] for i in _degenerate(k))))
    solids = T.solids(s, d).withColumn("node_ids", shape.otherwise(n))
    return rounded(M.element_quality(M.solid_corners(solids, T.nodes(s, d)).withColumn("state_idx", F.lit(0))).select("elem_id", "part_id", "aspect", "volume", "jacobian", "inverted"), 5)


def _angle(a, b, c):
    """SQL of the angle in degrees at corner b of a quad in GEO."""
    pos = lambda n: [f"{n}x", f"{n}y" if n != "b" else "by_", f"{n}z"]
    u = [f"({x} - {y})" for x, y in zip(pos(a), pos(b), strict=True)]
    v = [f"({x} - {y})" for x, y in zip(pos(c), pos(b), strict=True)]
    dot = " + ".join(f"{x}*{y}" for x, y in zip(u, v, strict=True))
    size = lambda w: "sqrt(" + " + ".join(f"{x}*{x}" for x in w) + ")"
    return f"degrees(acos(greatest(least(({dot}) / ({size(u)} * {size(v)}), 1), -1)))"


def _side(a, b):
    pos = lambda n: [f"{n}x", f"{n}y" if n != "b" else "by_", f"{n}z"]
    return "sqrt(" + " + ".join(f"({x} - {y})*({x} - {y})" for x, y in zip(pos(a), pos(b), strict=True)) + ")"


_SIDES = ", ".join(_side(a, b) for a, b in ("ab", "bc", "cd", "da"))
_SKEW = ", ".join(f"abs({_angle(*t)} - 90)" for t in ("dab", "abc", "bcd", "cda"))


@query(f"""WITH {GEO}, q AS (SELECT part_id, elem_idx * 6 + row_number() OVER (PARTITION BY elem_idx ORDER BY nodes) - 1 AS elem_id, greatest({_SIDES}) / least({_SIDES}) AS aspect, greatest({_SKEW}) / 90 AS skewness FROM g1)
  SELECT part_id, 0 AS state_idx, round(max(aspect), 5) AS max_aspect, round(avg(aspect), 5) AS avg_aspect, round(max(skewness), 5) AS max_skewness, count(*) FILTER (aspect > 5) AS n_high_aspect FROM q GROUP BY 1""")
def shell_quality(s, d):
    """Outer faces as shells of their parts."""
    g = _geometry(s, d).select("part_id", F.xxhash64("elem_idx", "nodes").alias("elem_id"), F.lit(0).alias("state_idx"), F.col("nodes").alias("node_ids"), *(f"p{i}" for i in range(4)))
    return rounded(M.part_quads(M.quad_quality(g)).select("part_id", "state_idx", "max_aspect", "avg_aspect", "max_skewness", "n_high_aspect"), 5)


@query()
def section_clip(s, d):
    """Polygons of the block at x = 4.5; tests compare them with the plane."""
    return M.section_clip(T.solids(s, d), T.nodes(s, d), (4.5, 0.0, 0.0), (1.0, 0.0, 0.0)).select("elem_idx", "part_id", "corners")

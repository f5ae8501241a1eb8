"""Mesh operators: faces, surfaces, boxes, element quality, nodal averages, sections.

Elements: etype, elem_idx, elem_id, part_id, node_ids. Nodes: node_id, x, y, z.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tensor import STRESS, TINY_LENGTH, Vector, with_face_stress, with_principals
from .extremes import at_largest, with_extremes

#: Fixed value: corners of the six faces of a hexahedron, outward.
HEXA_FACES = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))


def solid_faces(solids: DataFrame) -> DataFrame:
    """Six rows for each solid: etype, elem_idx, elem_id, part_id, nodes."""
    corner = lambda i: F.get("node_ids", F.lit(i))
    faces = F.array(*(F.array(*(corner(i) for i in f)) for f in HEXA_FACES))
    return solids.where("etype = 'SOLID'").select("etype", "elem_idx", "elem_id", "part_id", F.explode(faces).alias("nodes"))


def shell_faces(shells: DataFrame, bottom: bool = False) -> DataFrame:
    """A face for each shell, and the reversed one if asked."""
    top = shells.where("etype = 'SHELL'").select("etype", "elem_idx", "elem_id", "part_id", F.col("node_ids").alias("nodes"))
    if not bottom:
        return top
    under = top.withColumn("nodes", F.array(*(F.get("nodes", F.lit(i)) for i in (0, 3, 2, 1))))
    return top.union(under)


def exterior_faces(elements: DataFrame, parts_first: list[int] | None = None, parts_after: list[int] | None = None, solids: bool = True, shells: bool = True, bottom: bool = False) -> DataFrame:
    """Faces of solids that no other solid has, and all faces of shells; either alone if asked, with the shells' bottom too.

    With ``parts_first`` other parts don't count, so a face between two parts is exterior;
    ``parts_after`` picks from the exterior of the whole.
    """
    chosen = elements if parts_first is None else elements.where(F.col("part_id").isin(parts_first))
    faces = solid_faces(chosen).withColumn("__key", F.array_sort(F.array_distinct("nodes"))).where(F.size("__key") >= 3)
    names = ("etype", "elem_idx", "elem_id", "part_id", "nodes")
    once = faces.groupBy("__key").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in names)).where("__n = 1").select(*names)
    out = once.union(shell_faces(chosen, bottom)) if solids and shells else once if solids else shell_faces(chosen, bottom)
    return out if parts_after is None else out.where(F.col("part_id").isin(parts_after))


def with_corners(faces: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("etype", "elem_idx", "nodes")) -> DataFrame:
    """Adds p0 to p3, the places of the corners, by one join of all corners."""
    each = faces.select(*keys, F.posexplode("nodes").alias("__i", "node_id"))
    placed = each.join(nodes.select("node_id", F.struct("x", "y", "z").alias("p")), "node_id")
    corners = placed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__i", "p"))).alias("__p"))
    return faces.join(corners, list(keys)).select(*faces.columns, *(F.coalesce(F.col("__p")[i], F.col("__p")[2 if i == 3 else i]).alias(f"p{i}") for i in range(4)))


def corner(i: int) -> Vector:
    return Vector(*(F.col(f"p{i}.{c}") for c in "xyz"))


def quad_centroid() -> Vector:
    return (corner(0) + corner(1) + corner(2) + corner(3)).scale(0.25)


def quad_area() -> Column:
    """Of the two triangles of corners 0, 1, 2 and 0, 2, 3."""
    d = corner(2) - corner(0)
    return ((corner(1) - corner(0)).cross(d).length() + d.cross(corner(3) - corner(0)).length()) / 2


def face_geometry(faces: DataFrame) -> DataFrame:
    """Unit normal (of the diagonals; zero without one), centroid and area of faces with corners.

    In steps, each a column, so that no expression is built into another many times.
    """
    u, c = (corner(2) - corner(0)).cross(corner(3) - corner(1)), quad_centroid()
    raw = faces.withColumns({"__ux": u.x, "__uy": u.y, "__uz": u.z, "cx": c.x, "cy": c.y, "cz": c.z, "area": quad_area()})
    sized = raw.withColumn("__n", Vector(*(F.col(f"__u{k}") for k in "xyz")).length())
    return sized.withColumns({f"n{k}": F.when(F.col("__n") > TINY_LENGTH, F.try_divide(F.col(f"__u{k}"), F.col("__n"))).when(F.col("__n").isNotNull(), 0.0) for k in "xyz"}).drop("__ux", "__uy", "__uz", "__n")


def facing(faces: DataFrame, direction: tuple[float, float, float], degrees: float) -> DataFrame:
    """Faces whose normal is within an angle of a direction; a zero direction has none."""
    size = math.sqrt(sum(v * v for v in direction))
    if size == 0:
        return faces.limit(0)
    along = sum((F.col(n) * (v / size) for n, v in zip(("nx", "ny", "nz"), direction, strict=True)), F.lit(0.0))
    return faces.where((along >= math.cos(math.radians(degrees)) - 1e-12) & ((F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0)))


#: Surfaces of a job that names none: (name, direction, degrees).
DEFAULT_SURFACES = (("top", (0.0, 0.0, 1.0), 45.0), ("bottom", (0.0, 0.0, -1.0), 45.0))


def surface_stress(faces: DataFrame, states: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Statistics of the stress on a surface by state: von Mises, normal, shear, S1, S3.

    Joined on the element's class and index. Faces without a state give nothing, or zero
    stress if asked.
    """
    kind = "left" if missing_as_zero else "inner"
    both = faces.select("etype", "elem_idx", "elem_id", "nx", "ny", "nz", *(["surface"] if "surface" in faces.columns else [])).join(states, ["etype", "elem_idx"], kind)
    if missing_as_zero:
        both = both.fillna(0.0, ["sxx", "syy", "szz", "txy", "tyz", "tzx"])
    ready = with_face_stress(with_principals(both, STRESS, "s")).withColumn("vm", F.sqrt(3 * F.col("sj2")))
    by = [c for c in ("surface", "state_idx") if c in ready.columns]
    told = with_extremes(ready, ["vm"], F.col("elem_id").cast("long"))
    return told.groupBy(*by).agg(*(f(c).alias(f"{c}_{k}") for c in ("vm", "normal", "shear", "s1", "s3") for k, f in (("max", F.max), ("min", F.min), ("avg", F.avg))), at_largest("elem_id", "vm").alias("max_element"))


def surface_strain(faces: DataFrame, states: DataFrame) -> DataFrame:
    """Statistics of strain on a surface by state; has_tensor tells if any strain tensor was there."""
    from ..functions.tensor import strain

    both = faces.select("etype", "elem_idx", "nx", "ny", "nz", *(["surface"] if "surface" in faces.columns else [])).join(states, ["etype", "elem_idx"])
    e = strain()
    n = Vector(F.col("nx"), F.col("ny"), F.col("nz"))
    e1, _, e3 = e.principals()
    ready = both.withColumns({"evm": e.strain_von_mises(), "e_normal": e.normal(n), "e1": e1, "e3": e3})
    by = [c for c in ("surface", "state_idx") if c in ready.columns]
    return ready.groupBy(*by).agg(*(f(c).alias(f"{c}_{k}") for c in ("evm", "e_normal", "e1", "e3", "eps") for k, f in (("max", F.max), ("min", F.min), ("avg", F.avg))), F.max(F.col("exx").isNotNull()).alias("has_tensor"))


def node_parts(elements: DataFrame) -> DataFrame:
    """node_id, part_id: each pair once, from elements of every class."""
    return elements.select(F.explode("node_ids").alias("node_id"), "part_id").distinct()


def bounding_box(points: DataFrame, by: tuple[str, ...] = (), margin: float = 0.0) -> DataFrame:
    """Box of points, grown by a margin, with its diagonal and centre."""
    grouped = points.groupBy(*by).agg(*((f(c) + sign * margin).alias(f"{k}_{c}") for c in "xyz" for k, f, sign in (("min", F.min, -1), ("max", F.max, 1))))
    size = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    return grouped.withColumns({"diagonal": F.sqrt(reduce(lambda a, b: a + b, (s * s for s in size))), **{f"centre_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"}})


def section_positions(box: DataFrame, axis: str, count: int) -> DataFrame:
    """Evenly spaced section planes inside a box."""
    low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
    return box.select(F.explode(F.sequence(F.lit(1), F.lit(count))).alias("section"), low.alias("__l"), high.alias("__h")).select("section", (F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("section") / (count + 1)).alias("position"))


def sampled_states(states: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` states, evenly over their order, the first and the last among them: a feature of quality reports."""
    total = states.agg(F.count("*").alias("__n"))
    wanted = total.select(F.explode(F.when(F.col("__n") <= most, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(i * (F.col("__n") - 1) / (most - 1)).cast("long")))).alias("__i")).distinct()
    ranked = states.withColumn("__i", (F.row_number().over(Window.orderBy("state_idx")) - 1).cast("long"))  # the states table is small
    return ranked.join(wanted, "__i", "left_semi").drop("__i")


def _edges(pairs: tuple[tuple[int, int], ...], p: list[Vector]) -> list[Column]:
    return [(p[b] - p[a]).length() for a, b in pairs]


QUAD_EDGES = ((0, 1), (1, 2), (2, 3), (3, 0))
HEXA_EDGES = QUAD_EDGES + ((4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))


def aspect(p: list[Vector]) -> Column:
    """Longest over shortest edge; NULL with an edge that is nothing beside the longest."""
    e = _edges(QUAD_EDGES if len(p) == 4 else HEXA_EDGES, p)
    return F.when(F.least(*e) > F.greatest(*e) * 1e-9, F.try_divide(F.greatest(*e), F.least(*e)))


def skewness(p: list[Vector]) -> Column:
    """Largest departure of a corner angle of a quad from 90 degrees, as a share of 90."""
    angles = [(p[(i + 1) % 4] - p[i]).angle(p[(i + 3) % 4] - p[i]) for i in range(4)]
    return F.greatest(*(F.abs(a - 90) for a in angles)) / 90


def warpage(p: list[Vector]) -> Column:
    """Degrees between the normals of the two triangles of a quad."""
    d = p[2] - p[0]
    return (p[1] - p[0]).cross(d).angle(d.cross(p[3] - p[0]))


def tet_volume(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    return (b - a).cross(c - a).dot(d - a) / 6


def hexa_volume(p: list[Vector]) -> Column:
    """By five tetrahedra."""
    return reduce(lambda x, y: x + y, (tet_volume(*(p[i] for i in t)) for t in ((0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6))))


def solid_volume(p: list[Vector], nodes: Column) -> Column:
    """Signed volume of a solid of eight corners: by one tetrahedron where it has four different nodes, in order, else by five (which holds for wedges and pyramids too)."""
    place = F.transform(F.array_distinct(nodes), lambda v: F.array_position(nodes, v).cast("int") - 1)
    at = lambda k: [reduce(lambda a, i: F.when(F.get(place, F.lit(k)) == i, getattr(p[i], c)).otherwise(a), range(8), F.lit(None).cast("double")) for c in "xyz"]
    return F.when(F.size(place) == 4, tet_volume(*(Vector(*at(k)) for k in range(4)))).otherwise(hexa_volume(p))


def degenerate_strains(df: DataFrame, corners: str, out: str = "strain") -> DataFrame:
    """Adds the equivalent strain (of von Mises) of solids with fewer corners, as constant in the tetrahedron of the first four corners at different places; NULL where there are none or they are flat.

    ``corners`` is an array of structs x, y, z (places) and u, v, w (displacements). The
    displacement gradient is that of the displacements' differences by the inverse of the
    places' differences. In steps, each a column, so that no expression is built into another.
    """
    apart = lambda a, b: (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2 >= 1e-24
    seen = F.filter(corners, lambda c, i: F.forall(F.slice(F.col(corners), 1, i), lambda o: apart(o, c)))
    rows = df.withColumn("__first", F.slice(seen, 1, 4))
    edge = lambda k, c: F.get("__first", F.lit(k))[c] - F.get("__first", F.lit(0))[c]
    rows = rows.withColumns({f"__{c}{k}": edge(k, c) for k in (1, 2, 3) for c in ("x", "y", "z", "u", "v", "w")})
    place = [Vector(*(F.col(f"__{c}{k}") for c in "xyz")) for k in (1, 2, 3)]
    crosses = (place[1].cross(place[2]), place[2].cross(place[0]), place[0].cross(place[1]))
    rows = rows.withColumns({f"__c{c}{k}": getattr(v, c) for k, v in enumerate(crosses, 1) for c in "xyz"}).withColumn("__volume", place[0].dot(crosses[0]))
    slope = lambda c, a: sum((F.col(f"__{c}{k}") * F.col(f"__c{a}{k}") for k in (1, 2, 3)), F.lit(0.0))
    rows = rows.withColumns({f"__g{c}{a}": F.try_divide(slope(c, a), F.col("__volume")) for c in "uvw" for a in "xyz"})
    g = lambda c, a: F.col(f"__g{c}{a}")
    rows = rows.withColumn("__mean", (g("u", "x") + g("v", "y") + g("w", "z")) / 3)
    square = sum(((g(c, a) - F.col("__mean")) ** 2 for c, a in zip("uvw", "xyz", strict=True)), F.lit(0.0))
    square += sum(((g(*p) + g(*q)) ** 2 / 2 for p, q in (("uy", "vx"), ("vz", "wy"), ("uz", "wx"))), F.lit(0.0))
    found = F.when((F.size("__first") == 4) & (F.abs("__volume") > 1e-30), F.sqrt(2 / 3 * square))
    return rows.withColumn(out, found).select(*[c for c in df.columns if c != out], out)


#: Fixed value: of each corner of a hexahedron its three neighbours, right-handed.
CORNERS = ((1, 3, 4), (2, 0, 5), (3, 1, 6), (0, 2, 7), (7, 5, 0), (4, 6, 1), (5, 7, 2), (6, 4, 3))


def scaled_jacobian(p: list[Vector]) -> Column:
    """Least of the corners' triple products of unit edges; corners with an edge of no length are left out."""
    values = []
    for i, (a, b, c) in enumerate(CORNERS):
        u, v, w = p[a] - p[i], p[b] - p[i], p[c] - p[i]
        size = u.length() * v.length() * w.length()
        values.append(F.when(size > 1e-12, F.try_divide(u.cross(v).dot(w), size)))
    return F.least(*values)


def part_properties(solids: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """part_id, volume, mass (by ``density``: part_id, density; NULL without) and centroid (by volume) of solids with corners p0 to p7."""
    p = [corner(i) for i in range(8)]
    middle = reduce(lambda a, b: a + b, p).scale(1 / 8)
    each = solids.select("part_id", F.abs(solid_volume(p, F.col("node_ids"))).alias("v"), middle.x.alias("x"), middle.y.alias("y"), middle.z.alias("z"))
    out = each.groupBy("part_id").agg(F.sum("v").alias("volume"), *(F.try_divide(F.sum(F.col("v") * F.col(c)), F.sum("v")).alias(f"centroid_{c}") for c in "xyz"))
    if density is None:
        return out.withColumn("mass", F.lit(None).cast("double"))
    return out.join(density, "part_id", "left").withColumn("mass", F.col("volume") * F.col("density")).drop("density")


def solid_corners(solids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Solids with the places of their eight corners, p0 to p7, by one join of all corners."""
    each = solids.where("etype = 'SOLID'").select("elem_id", "part_id", "node_ids", F.posexplode("node_ids").alias("__i", "node_id"))
    placed = each.join(nodes.select("node_id", F.struct("x", "y", "z").alias("p")), "node_id")
    held = placed.groupBy("elem_id", "part_id", "node_ids").agg(F.map_from_entries(F.collect_list(F.struct("__i", "p"))).alias("__p"))
    return held.select("elem_id", "part_id", "node_ids", *(F.col("__p")[i].alias(f"p{i}") for i in range(8)))


#: An aspect over which an element is stretched; a first volume or area under which no ratio is taken.
HIGH_ASPECT, NO_SIZE = 5.0, 1e-20


def _ratio(size: str) -> Column:
    """The size over that of the element's first state."""
    first = F.first(F.col(size)).over(Window.partitionBy("elem_id").orderBy("state_idx"))
    return F.when(first > NO_SIZE, F.abs(F.col(size)) / first)


def element_quality(solids: DataFrame) -> DataFrame:
    """aspect, volume, scaled Jacobian, volume_ratio to the first state and inverted of solids with corners p0 to p7.

    Corners that are one node (by node_ids, or by their places where there are none) make a
    solid with fewer: its volume is that of a tetrahedron of four, it has no Jacobian and no
    ratio, and it is inverted where its volume is negative.
    """
    p = [corner(i) for i in range(8)]
    nodes = F.col("node_ids") if "node_ids" in solids.columns else F.array(*(F.col(f"p{i}") for i in range(8)))
    ready = solids.select("part_id", "elem_id", "state_idx", (F.size(F.array_distinct(nodes)) == 8).alias("__full"), aspect(p).alias("aspect"), solid_volume(p, nodes).alias("volume"), scaled_jacobian(p).alias("jacobian"))
    ready = ready.withColumn("jacobian", F.when(F.col("__full"), F.col("jacobian")))
    inverted = F.coalesce(F.col("jacobian"), F.col("volume")) < 0
    return ready.withColumn("volume_ratio", F.when(F.col("__full"), _ratio("volume"))).withColumn("inverted", F.coalesce(inverted, F.lit(False))).drop("__full")


def quad_quality(shells: DataFrame) -> DataFrame:
    """aspect, skewness, warpage, area and area_ratio to the first state of shells with corners p0 to p3 and node_ids.

    A triangle (its last two nodes are one) has the aspect of three edges, and neither skewness
    nor warpage; a collapsed shell has no aspect, and nothing else either.
    """
    p = [corner(i) for i in range(4)]
    triangle = F.get("node_ids", F.lit(2)) == F.get("node_ids", F.lit(3))
    e = _edges(((0, 1), (1, 2), (2, 0)), p)
    three = F.when(F.least(*e) > NO_SIZE, F.greatest(*e) / F.least(*e))
    half = (p[1] - p[0]).cross(p[2] - p[0]).length() / 2
    ready = shells.select("part_id", "elem_id", "state_idx", triangle.alias("__t"), F.when(triangle, three).otherwise(aspect(p)).alias("aspect"), skewness(p).alias("skewness"), warpage(p).alias("warpage"), F.when(triangle, half).otherwise(quad_area()).alias("area"))
    there = F.col("aspect").isNotNull()
    told = ready.withColumns({c: F.when(there & ~F.col("__t"), F.col(c)) for c in ("skewness", "warpage")}).withColumn("area_ratio", F.when(there, _ratio("area")))
    return told.drop("__t")


def part_quality(quality: DataFrame) -> DataFrame:
    """Solids by part and state; NULL where nothing is defined."""
    return quality.groupBy("part_id", "state_idx").agg(F.max("aspect").alias("max_aspect"), F.avg("aspect").alias("avg_aspect"), F.min("jacobian").alias("min_jacobian"), F.min("volume_ratio").alias("min_volume_ratio"), F.max("volume_ratio").alias("max_volume_ratio"), F.count_if("inverted").alias("n_negative_jacobian"), F.count_if(F.col("aspect") > HIGH_ASPECT).alias("n_high_aspect"))


def part_quads(quality: DataFrame) -> DataFrame:
    """Shells by part and state."""
    return quality.groupBy("part_id", "state_idx").agg(F.max("aspect").alias("max_aspect"), F.avg("aspect").alias("avg_aspect"), F.max("skewness").alias("max_skewness"), F.max("warpage").alias("max_warpage"), F.min("area_ratio").alias("min_area_ratio"), F.max("area_ratio").alias("max_area_ratio"), F.count_if(F.col("aspect") > HIGH_ASPECT).alias("n_high_aspect"))


def nodal_average(elements: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Mean of an element field at each node and state."""
    each = elements.select("etype", "elem_idx", F.explode(F.array_distinct("node_ids")).alias("node_id"))
    return each.join(values, ["etype", "elem_idx"]).groupBy("node_id", "state_idx").agg(F.avg(value).alias(value))


def section_clip(elements: DataFrame, nodes: DataFrame, point: tuple[float, float, float], normal: tuple[float, float, float], value: str | None = None, slab: float = 0.0) -> DataFrame:
    """Polygons where a plane cuts the elements' edges: corners in order about their centre, values interpolated.

    Signed distances come with the corners in one join; edges whose ends are on two sides
    give a point each. Nodes within half the thickness of a ``slab`` count as on the plane.
    """
    size = sum(v * v for v in normal) ** 0.5
    n = [v / size for v in normal]
    distance = reduce(lambda a, b: a + b, ((F.col(c) - o) * k for c, o, k in zip("xyz", point, n, strict=True)))
    half = slab / 2
    distance = F.when((F.lit(half) > 0) & (F.abs(distance) <= half), 0.0).otherwise(distance)
    at = nodes.select("node_id", F.struct(distance.alias("d"), "x", "y", "z", *([F.col(value).alias("v")] if value else [F.lit(None).cast("double").alias("v")])).alias("q"))
    each = elements.select("etype", "elem_idx", "part_id", F.posexplode("node_ids").alias("i", "node_id")).join(at, "node_id")
    held = each.groupBy("etype", "elem_idx", "part_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("q"))
    pairs = F.when(F.size("q") == 8, F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in HEXA_EDGES))).otherwise(F.transform(F.sequence(F.lit(0), F.size("q") - 1), lambda i: F.struct(i.alias("a"), F.pmod(i + 1, F.size("q")).alias("b"))))
    ends = held.select("etype", "elem_idx", "part_id", "q", F.explode(pairs).alias("e")).select("etype", "elem_idx", "part_id", F.col("q")[F.col("e.a")].alias("a"), F.col("q")[F.col("e.b")].alias("b"))
    crossing = ends.where(((F.col("a.d") < 0) & (F.col("b.d") >= 0)) | ((F.col("a.d") >= 0) & (F.col("b.d") < 0)))
    t = F.col("a.d") / (F.col("a.d") - F.col("b.d"))
    points = crossing.select("etype", "elem_idx", "part_id", *((F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t).alias(c) for c in ("x", "y", "z", "v")))
    axis = max(range(3), key=lambda i: abs(n[i]))
    u, w = ("xyz"[i] for i in range(3) if i != axis)
    own = Window.partitionBy("etype", "elem_idx")
    turned = points.withColumn("__t", F.atan2(F.col(w) - F.avg(w).over(own), F.col(u) - F.avg(u).over(own)))
    return turned.groupBy("etype", "elem_idx", "part_id").agg(F.count("*").alias("corners"), F.transform(F.sort_array(F.collect_list(F.struct("__t", "x", "y", "z", "v"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"), s["v"].alias("v"))).alias("polygon"))

"""Round trips of sources and sinks: files are written from the tables, read again, and compared with the tables' SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parts as P
from ..sources import binary, history, sinks, text
from . import tables as T
from .registry import query, rounded
from .storage import discard, new_path


def _text(rows: DataFrame, name: str = "") -> str:
    """Write values (a line, or the lines of a card) in order of n as files of a new folder, or of the folder ``name``; a value is never cut."""
    path = name or new_path(rows.sparkSession)
    rows.repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
    return path


def _one_file(rows: DataFrame, name: str = "") -> str:
    """Write the few lines of a log or of a deck's head as one file."""
    path = name or new_path(rows.sparkSession)
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
    return path


def _cards(rows: DataFrame, n: Column, *of: Column) -> DataFrame:
    """n and value: the lines of a card in one value."""
    return rows.select(n.cast("long").alias("n"), F.array_join(F.concat(*of), "\n").alias("value"))


def _lines(s: SparkSession, *lines: str) -> DataFrame:
    return s.createDataFrame(list(enumerate(lines, -1_000_000)), "n long, value string")


# Result families: the suppliers are nodes, the parts solids and the nations beams; a state for each month of lineitem, a file for each year

MONTH = "((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)"
#: Words of a solid, of a beam, and global ones, from the rows of a month.
SOLID_WORDS = ("max(l_quantity)", "max(l_extendedprice)", "min(l_extendedprice)", "max(l_discount)", "min(l_discount)", "max(l_tax)", "count(*)")
BEAM_WORDS = ("max(l_extendedprice)", "min(l_extendedprice)", "max(l_quantity)", "min(l_quantity)", "max(l_tax)", "count(*)")
GLOBAL_WORDS = ("count(*)", "max(l_quantity)", "max(l_extendedprice)", "min(l_extendedprice)", "max(l_discount)", "max(l_tax)")


def _family(s: SparkSession, d: str, order: str = "<", size: int = 8, states_per_file: int = 12) -> str:
    """The family of the tables; absolute counts and doubles stay exact in words of eight bytes."""
    base = f"{new_path(s)}/result"
    item = T.read(s, d, "lineitem").withColumn("state_idx", F.expr(MONTH).cast("int"))
    supplier, points = T.read(s, d, "supplier"), T.points(s, d)
    nodes = points.select(F.col("point_id").cast("int").alias("node_idx"), (F.col("point_id") + 1000).cast("int").alias("node_id"), "x", "y", "z")
    count = supplier.agg((F.max("s_suppkey") + 1).cast("int").alias("n"))
    corner = lambda i, k: F.pmod(i + k, F.col("n")).cast("int")
    part, nation = T.read(s, d, "part").crossJoin(F.broadcast(count)), T.read(s, d, "nation").crossJoin(F.broadcast(count))  # one row
    solids = part.select(F.lit("SOLID").alias("etype"), F.col("p_partkey").cast("int").alias("elem_idx"), (F.col("p_partkey") + 500).cast("int").alias("elem_id"), F.col("p_size").alias("material_id"), F.array(*(corner(F.col("p_partkey"), k) for k in (0, 1, 6, 5, 10, 11, 16, 15))).alias("node_ids"))
    beams = nation.select(F.lit("BEAM"), "n_nationkey", F.col("n_nationkey") + 900, F.col("n_regionkey") + 7, F.array(corner(F.col("n_nationkey"), 0), corner(F.col("n_nationkey"), 1)))
    words = lambda some: F.array(*(F.expr(w).cast("double") for w in some))
    states = item.groupBy("state_idx").agg(words(GLOBAL_WORDS).alias("globals")).withColumn("time", (F.col("state_idx") + 1) * F.lit(0.001))
    moved = nodes.crossJoin(F.broadcast(states.select("state_idx"))).select("state_idx", "node_idx", *((F.col(c) + F.col("state_idx") * k).alias(c) for c, k in (("x", 0.5), ("y", 0.25), ("z", -0.125))), *((F.col("node_idx") * k + F.col("state_idx")).cast("double").alias(c) for k, c in enumerate(("vx", "vy", "vz", "ax", "ay", "az"), 1)))  # the months are few
    cells = item.select("state_idx", F.col("l_partkey").cast("int").alias("elem_idx"), "l_quantity", "l_extendedprice", "l_discount", "l_tax").repartition("state_idx", "elem_idx")  # most cells have a row or two, so tasks cannot sum up much first: rows are smaller than sums
    by_part = cells.groupBy("state_idx", "elem_idx").agg(words(SOLID_WORDS).alias("words"))
    by_nation = item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("state_idx", F.col("s_nationkey").alias("elem_idx")).agg(words(BEAM_WORDS).alias("words"))
    binary.write_family(base, "lineitem by months", nodes, solids.union(beams), states, moved, {"SOLID": by_part, "BEAM": by_nation}, order, size, states_per_file, widths={"SOLID": len(SOLID_WORDS), "BEAM": len(BEAM_WORDS)})
    return base


def _words(some: tuple[str, ...], by: str, source: str) -> str:
    return f"SELECT {MONTH}::INTEGER AS k, {by}::INTEGER AS e, {', '.join(f'{w}::DOUBLE AS w{i}' for i, w in enumerate(some))} FROM {source} GROUP BY 1, 2"


FAMILY = f"""months AS (SELECT DISTINCT {MONTH}::INTEGER AS k FROM lineitem), every AS (SELECT unnest(range(max(k) + 1))::INTEGER AS k FROM months), size AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
sw AS ({_words(SOLID_WORDS, "l_partkey", "lineitem")}), bw AS ({_words(BEAM_WORDS, "s_nationkey", "lineitem JOIN supplier ON l_suppkey = s_suppkey")}), gw AS ({_words(GLOBAL_WORDS, "0", "lineitem")})"""
#: A file, a place in it and a time for each state; what no row names is zero.
PLACE = "(k // 12 + 1)::INTEGER AS part, (k % 12)::INTEGER AS place, CASE WHEN k IN (SELECT k FROM months) THEN (k + 1) * 0.001::DOUBLE ELSE 0 END AS time"


@query(f"""WITH {FAMILY}, c AS (SELECT (SELECT n FROM size) AS nodes, (SELECT max(p_partkey) + 1 FROM part) AS solids, (SELECT max(n_nationkey) + 1 FROM nation) AS beams)
SELECT 'lineitem by months' AS title, word, nodes::INTEGER AS nodes, solids::INTEGER AS solids, beams::INTEGER AS beams, 6 AS globals, 7 AS solid_words, 6 AS beam_words, (10 + nodes + solids + beams)::INTEGER AS ids FROM c, (VALUES (4), (8)) t(word)""")
def result_headers(s, d):
    """The headers of two families, with words of four bytes in one order and of eight in the other."""
    rows = []
    for order, size in (("<", 4), (">", 8)):
        base = _family(s, d, order, size)
        at = binary.layout(s, base)
        discard(s, base.rsplit("/", 1)[0])  # the next one is as large
        rows.append((at.title, at.size, *(at.n[k] for k in ("numnp", "nel8", "nel2", "nglbv", "nv3d", "nv1d", "narbs"))))
    return s.createDataFrame(rows, "title string, word int, nodes int, solids int, beams int, globals int, solid_words int, beam_words int, ids int")


@query(f"WITH {FAMILY} SELECT 0 AS part, 'result' AS name UNION ALL SELECT DISTINCT (k // 12 + 1)::INTEGER, 'result' || lpad((k // 12 + 1)::VARCHAR, 2, '0') FROM every")
def result_family_files(s, d):
    return binary.family(s, _family(s, d)).select("part", F.regexp_extract("path", "[^/]*$", 0).alias("name"))


@query(f"WITH {T.POINTS} SELECT point_id::INTEGER AS node_idx, (1000 + point_id)::INTEGER AS node_id, x, y, z FROM pts")
def result_nodes(s, d):
    return binary.nodes(s, _family(s, d), 1 << 10)


@query(f"""WITH {FAMILY} SELECT 'SOLID' AS etype, p_partkey::INTEGER AS elem_idx, (500 + p_partkey)::INTEGER AS elem_id, p_size AS part_id, array_to_string(list_transform([0, 1, 6, 5, 10, 11, 16, 15], lambda j: (p_partkey + j) % n), ' ') AS nodes FROM part, size
  UNION ALL SELECT 'BEAM', n_nationkey, 900 + n_nationkey, 7 + n_regionkey, (n_nationkey % n) || ' ' || ((n_nationkey + 1) % n) FROM nation, size""")
def result_elements(s, d):
    return binary.elements(s, _family(s, d), 1 << 14).select("etype", "elem_idx", "elem_id", "part_id", F.array_join(F.transform("node_ids", lambda i: i.cast("string")), " ").alias("nodes"))


@query(f"WITH {FAMILY} SELECT {PLACE} FROM every")
def result_state_times(s, d):
    return binary.times(s, _family(s, d, ">"))


@query(f"""WITH {T.POINTS}, {FAMILY} SELECT (k + 1) * 0.001::DOUBLE AS time, point_id::INTEGER AS node_idx, x + k * 0.5::DOUBLE AS x, y + k * 0.25::DOUBLE AS y, z - k * 0.125::DOUBLE AS z,
  (point_id + k)::DOUBLE AS vx, (point_id * 2 + k)::DOUBLE AS vy, (point_id * 3 + k)::DOUBLE AS vz, (point_id * 4 + k)::DOUBLE AS ax, (point_id * 5 + k)::DOUBLE AS ay, (point_id * 6 + k)::DOUBLE AS az FROM months, pts""")
def result_node_states(s, d):
    return binary.node_states(s, _family(s, d), span=1 << 12).where("time > 0").drop("part", "state")


@query(f"WITH {FAMILY} SELECT {PLACE.replace('AS place', 'AS state')}, i::INTEGER AS i, coalesce(CASE i {' '.join(f'WHEN {i} THEN w{i}' for i in range(6))} END, 0) AS value FROM every LEFT JOIN gw USING (k), range(6) t(i)")
def result_global_states(s, d):
    return binary.global_states(s, _family(s, d))


@query(f"""WITH {FAMILY}, every_part AS (SELECT unnest(range((SELECT max(p_partkey) + 1 FROM part)))::INTEGER AS e), every_nation AS (SELECT unnest(range((SELECT max(n_nationkey) + 1 FROM nation)))::INTEGER AS e)
  SELECT 'SOLID' AS etype, {PLACE}, e AS elem_idx, {', '.join(f'coalesce(w{i}, 0) AS w{i}' for i in range(7))} FROM every CROSS JOIN every_part LEFT JOIN sw USING (k, e)
  UNION ALL SELECT 'BEAM', {PLACE}, e, {', '.join(f'coalesce(w{i}, 0)' for i in range(6))}, NULL FROM every CROSS JOIN every_nation LEFT JOIN bw USING (k, e)""")
def result_element_states(s, d):
    """lineitem by part, nation and month, written as a family and read back by ranges of states and elements."""
    base, out = _family(s, d), None
    for kind in ("SOLID", "BEAM"):
        rows = binary.element_states(s, base, kind, span=1 << 16)
        one = rows.select(F.lit(kind).alias("etype"), "part", "place", "time", "elem_idx", *(F.get("words", F.lit(i)).alias(f"w{i}") for i in range(7)))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {FAMILY} SELECT {PLACE}, e AS elem_idx, w1 AS price, w6 AS rows FROM every JOIN sw USING (k) WHERE k // 12 IN (1, 3) AND k % 12 < 6")
def result_element_words_of_some_states(s, d):
    """Two words of each solid, of the first half of two files: other ranges are no tasks, other words do not leave them."""
    rows = binary.element_states(s, _family(s, d), "SOLID", (1, 6)).where("part in (2, 4) and place < 6")
    return rows.select("part", "place", "time", "elem_idx", F.col("words")[0].alias("price"), F.col("words")[1].alias("rows")).where("rows > 0")


@query(f"""WITH {T.POINTS}, {FAMILY} SELECT s_nationkey AS part_id, k AS state_idx, (k + 1) * 0.001::DOUBLE AS time, round(avg(k * 0.5::DOUBLE), 6) AS mean_x, round(max(sqrt(k * 0.5::DOUBLE * (k * 0.5::DOUBLE) + k * 0.25::DOUBLE * (k * 0.25::DOUBLE) + k * 0.125::DOUBLE * (k * 0.125::DOUBLE))), 6) AS max_displacement FROM months, supplier GROUP BY 1, 2""")
def part_motion_of_a_result(s, d):
    """Displacement of the suppliers of each nation, from the places alone: velocities are not read."""
    base = _family(s, d)
    still = binary.nodes(s, base).select("node_idx", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    rows = binary.node_states(s, base, ("place",)).where("time > 0")
    rows = rows.join(still, "node_idx").withColumn("state_idx", (F.col("part") - 1) * 12 + F.col("state")).drop("state").withColumnRenamed("node_idx", "node_id")
    parts = T.read(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("node_id"), F.col("s_nationkey").alias("part_id"))
    return rounded(P.motion(rows.drop("part"), parts).select("part_id", "state_idx", "time", "mean_x", "max_displacement"))


@query(f"""WITH {T.POINTS}, {FAMILY}, b AS (SELECT max(n_nationkey) + 1 AS beams FROM nation) SELECT 'point' AS kind, point_id::INTEGER AS i, x::INTEGER || ' ' || y::INTEGER || ' ' || z::INTEGER AS value FROM pts
  UNION ALL SELECT 'cell 3', n_nationkey, (n_nationkey % n) || ' ' || ((n_nationkey + 1) % n) FROM nation, size
  UNION ALL SELECT 'cell 12', p_partkey + beams, array_to_string(list_transform([0, 1, 6, 5, 10, 11, 16, 15], lambda j: (p_partkey + j) % n), ' ') FROM part, size, b""")
def result_to_vtk_and_back(s, d):
    base, path = _family(s, d), new_path(s)
    sinks.write_vtk(binary.nodes(s, base), binary.elements(s, base), path)
    points, cells = text.vtk_grid(s, path)
    shown = F.concat_ws(" ", *(F.col(c).cast("int").cast("string") for c in "xyz"))
    named = F.concat(F.lit("cell "), F.col("cell_type").cast("string"))
    return points.select(F.lit("point").alias("kind"), F.col("node_idx").alias("i"), shown.alias("value")).union(cells.select(named, "elem_idx", F.array_join(F.transform("node_ids", lambda v: v.cast("string")), " ")))


# Binary histories: events as times, a file for each thousand; a file begins again with the last time of the one before, which had other values

TIMES_OF_A_FILE = 1000
#: Branches and their records: (name, form, values of a time); then what stays, for each file.
BRANCHES = {
    "glstat": [("kinetic_energy", "f8", "v"), ("internal_energy", "f8", "v / 2"), ("total_energy", "f8", "v * 2")],
    "rcforc": [(f"{c}_force", "f8", f"v + {j}, v + {2 * j}, v + {3 * j}") for j, c in enumerate("xyz", 1)],
    "matsum": [("kinetic_energy", "f8", "v, -v"), ("internal_energy", "f8", "v + 1, v + 2")],
    "sleout": [("total_energy", "f8", "v * 4, v * 8"), ("friction_energy", "f8", "v / 4, v / 8")],
}
STAYS = {"glstat": [("title", "i1", "97, 32, 114, 117, 110")], "rcforc": [("ids", "i4", "7, 7, 9"), ("side", "i4", "0, 1, 0")], "matsum": [("ids", "i8", "1, 2")], "sleout": [("ids", "i4", "3, 4"), ("legend", "i1", "100, 111, 111, 114, 32, 32, 112, 105, 108, 108, 97, 114")]}


def _history(s: SparkSession, d: str, branch: str, little: bool = True) -> DataFrame:
    """The rows of a branch of a history written from events."""
    i = F.col("event_id")
    e = T.read(s, d, "events").select(i, F.col("value").alias("v"), F.floor(i / TIMES_OF_A_FILE).cast("int").alias("f"))
    before = e.where((i % TIMES_OF_A_FILE == 0) & (i > 0)).select("event_id", (F.col("v") - 1).alias("v"), (F.col("f") - 1).alias("f"))
    record = lambda folder, r: F.struct(folder.alias("folder"), F.lit(r[0]).alias("name"), F.lit(r[1]).alias("form"), F.expr(f"cast(array({r[2]}) as array<double>)").alias("values"))
    padded = lambda n, width: F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0"))
    moving = [record(F.concat(F.lit(f"/{b}/"), "state"), r) for b, own in BRANCHES.items() for r in [("time", "f8", "event_id * 0.5"), *own]]
    still = [record(F.lit(f"/{b}/metadata"), r) for b, own in STAYS.items() for r in own]
    times = e.union(before).repartition("f").withColumns({"state": F.concat(F.lit("d"), padded(i - F.col("f") * TIMES_OF_A_FILE + 1, 6)), "file": F.concat(F.lit("binout"), padded(F.col("f"), 4))})  # spread before a time becomes many records
    files = e.select("f").distinct().select(F.concat(F.lit("binout"), padded(F.col("f"), 4)).alias("file"))
    rows = times.select("file", "event_id", F.posexplode(F.array(*moving)).alias("k", "r")).union(files.select("file", F.lit(-1), F.posexplode(F.array(*still))))
    root = new_path(s)
    history.write(rows.select("file", (F.col("event_id") * 100 + F.col("k")).alias("at"), "r.*"), root, little, files.count())
    return history.read(s, f"{root}/binout*", [branch])


HISTORY = f"""h0 AS (SELECT event_id, value AS v, event_id // {TIMES_OF_A_FILE} AS f FROM events), h AS (SELECT * FROM h0 UNION ALL SELECT event_id, v - 1, f - 1 FROM h0 WHERE event_id % {TIMES_OF_A_FILE} = 0 AND event_id > 0)"""


@query("SELECT event_id * 0.5::DOUBLE AS t, value AS ke, value / 2 AS ie, NULL::DOUBLE AS hourglass, NULL::DOUBLE AS sliding, value * 2 AS total FROM events")
def history_energies(s, d):
    return history.energies(_history(s, d, "glstat"))


@query(f"WITH {HISTORY} SELECT [7, 7, 9][k]::INTEGER AS interface_id, [0, 1, 0][k]::INTEGER AS side, event_id * 0.5::DOUBLE AS t, v + k AS fx, v + 2 * k AS fy, v + 3 * k AS fz FROM h, range(1, 4) c(k)")
def history_contact_forces(s, d):
    return history.contact_forces(_history(s, d, "rcforc", False))


@query(f"WITH {HISTORY} SELECT k::INTEGER AS part_id, event_id * 0.5::DOUBLE AS t, CASE k WHEN 1 THEN v ELSE -v END AS ke, v + k AS ie FROM h, range(1, 3) c(k)")
def history_part_energies(s, d):
    return history.part_energies(_history(s, d, "matsum"))


@query(f"WITH {HISTORY} SELECT (k + 2)::INTEGER AS interface_id, ['door', 'pillar'][k] AS name, event_id * 0.5::DOUBLE AS t, v * 4 * k AS total_energy, v / (4 * k) AS friction_energy FROM h, range(1, 3) c(k)")
def history_sliding_energies(s, d):
    return history.sliding_energies(_history(s, d, "sleout"))


# Keyword decks

def _deck(s: SparkSession, d: str) -> str:
    path = new_path(s)
    sinks.write_deck(sinks.keyword_nodes(T.nodes(s, d)), "*NODE", path)
    return path


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT node_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM nodes")
def deck_nodes(s, d):
    return rounded(text.keyword_nodes(s, _deck(s, d)))


@query(f"WITH {T.SOLIDS} SELECT 'SOLID' AS etype, elem_id, part_id, array_to_string(node_ids, ' ') AS nodes FROM solids WHERE list_min(node_ids) > 0")
def deck_elements(s, d):
    own = T.solids(s, d).where(F.array_min("node_ids") > 0)
    line = F.concat(F.format_string("%8d%8d", "elem_id", "part_id"), *(F.format_string("%8d", F.col("node_ids")[i]) for i in range(8)))
    path = new_path(s)
    sinks.write_deck(own.select(F.col("elem_id").alias("node_id"), line.alias("value")), "*ELEMENT_SOLID", path)
    return text.keyword_elements(s, path).select("etype", "elem_id", "part_id", F.array_join(F.transform("node_ids", lambda i: i.cast("string")), " ").alias("nodes"))


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT node_id, round(x, 6) AS x FROM nodes WHERE node_id % 3 = 0 UNION ALL SELECT node_id + 5000, round(y, 6) FROM nodes WHERE node_id % 4 = 0 UNION ALL SELECT 99, 1.5::DOUBLE")
def deck_includes(s, d):
    """A deck that includes two others, one of which includes the first again."""
    root, nodes = new_path(s), T.nodes(s, d)
    line = lambda i, x: F.concat_ws(",", i.cast("string"), F.format_string("%.9f", x), F.lit("0"), F.lit("0"))
    a = nodes.where("node_id % 3 = 0").select("node_id", line(F.col("node_id"), F.col("x")).alias("value"))
    b = nodes.where("node_id % 4 = 0").select("node_id", line(F.col("node_id") + 5000, F.col("y")).alias("value"))
    sinks.write_deck(a, "*NODE", f"{root}/a.k")
    sinks.write_deck(b, "*INCLUDE\na.k\n*NODE", f"{root}/b.k")
    _one_file(_lines(s, "*KEYWORD", "$ a comment", "*INCLUDE", "a.k", "*INCLUDE", "b.k", "*NODE", "99,1.5,0,0", "*END", "*NODE", "98,0,0,0"), f"{root}/main.k")
    return rounded(text.keyword_nodes(s, text.included(s, f"{root}/main.k")).select("node_id", "x"))


@query("""SELECT 'PART' AS kind, s_nationkey + 1 AS set_id, array_to_string(list(s_suppkey::INTEGER ORDER BY s_suppkey), ' ') AS ids, 0 AS segments, NULL::VARCHAR AS warning FROM supplier WHERE s_suppkey > 0 GROUP BY s_nationkey
  UNION ALL SELECT 'NODE', 900, '3 4 5 9 10', 0, NULL UNION ALL SELECT 'SEGMENT', 901, '', 2, NULL UNION ALL SELECT 'SHELL', 902, '8 9', 0, NULL UNION ALL SELECT 'NODE', 903, '5 6', 0, 'row of this kind is skipped' UNION ALL SELECT 'NODE', 904, '', 0, 'card of sets of sets is skipped'""")
def deck_sets(s, d):
    rows = T.read(s, d, "supplier").where("s_suppkey > 0")
    own = rows.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.col("s_suppkey").cast("int"))).alias("ids"))  # suppliers of a nation are a set
    eight = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / 8).cast("int")), lambda k: F.array_join(F.transform(F.slice("ids", k * 8 + 1, 8), lambda i: F.lpad(i.cast("string"), 10, " ")), ""))
    lines = _cards(own, F.col("s_nationkey"), F.array(F.lit("*SET_PART_LIST"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 10, " ")), eight)
    fixed = "\n".join(["*SET_NODE_LIST_GENERATE_TITLE", "a title", "900", "3,5,9,10", "*SET_SEGMENT", "901", "1,2,3,4", "5,6,7", "*SET_SHELL_COLUMN", "902", "8,0.5", "9,0.5", "*SET_NODE_GENERAL", "903", "NODE,5,6", "BOX,1", "*SET_NODE_ADD", "904", "900,903"])
    path = _text(lines.union(_lines(s, fixed)))
    return text.keyword_sets(s, path).select("kind", "set_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.size("segments").alias("segments"), "warning")


@query("SELECT p_partkey::INTEGER AS part_id, p_name AS name, (p_size + 1)::INTEGER AS section_id, (p_size % 7 + 1)::INTEGER AS material_id FROM part WHERE p_partkey > 0")
def deck_parts(s, d):
    p = T.read(s, d, "part").where("p_partkey > 0")
    numbers = F.format_string("%10d%10d%10d", F.col("p_partkey"), F.col("p_size") + 1, F.col("p_size") % 7 + 1)
    return text.keyword_parts(s, _text(_cards(p, F.col("p_partkey"), F.array(F.lit("*PART"), F.col("p_name"), numbers))))


@query("SELECT n_nationkey + 1 AS material_id, '*MAT_ELASTIC' || CASE WHEN n_nationkey % 2 = 0 THEN '_TITLE' ELSE '' END AS card, (n_nationkey + 1) * 0.5::DOUBLE AS density, 1500.0::DOUBLE AS modulus, 0.25::DOUBLE AS ratio FROM nation")
def deck_materials(s, d):
    k = F.col("n_nationkey")
    head = F.array(F.concat(F.lit("*MAT_ELASTIC"), F.when(k % 2 == 0, "_TITLE").otherwise("")))
    title = F.when(k % 2 == 0, F.array(F.col("n_name"))).otherwise(F.array().cast("array<string>"))
    body = F.array(F.concat(F.format_string("%10d%10.3f", k + 1, (k + 1) * 0.5), F.lit("  1.5D+03 2.50e-01")))
    path = _text(_cards(T.read(s, d, "nation"), k, head, title, body))
    return text.keyword_materials(s, path).select("material_id", "card", "density", "modulus", "ratio")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), own AS (SELECT DISTINCT unnest([s_suppkey, s_suppkey + 1]) AS node, s_nationkey AS part FROM supplier),
sided AS (SELECT k, 0 AS side, 3 AS kind, k + 1 AS part_id FROM n UNION ALL SELECT a.k, 1, 2, b.k + 1 FROM n a JOIN n b ON a.r = b.r
  UNION SELECT 1000 + k, 0, 4, own.part FROM n JOIN supplier ON s_nationkey = k JOIN own ON own.node = s_suppkey WHERE s_suppkey > 0 UNION SELECT 1000 + k, 1, 0, own.part FROM n JOIN own ON own.node IN (k, k + 1, k + 2, k + 3) WHERE own.node > 0),
ranked AS (SELECT k, dense_rank() OVER (ORDER BY k) AS i FROM (SELECT k FROM n UNION SELECT 1000 + k FROM n))
SELECT i::INTEGER AS interface, side::INTEGER AS side, kind::INTEGER AS kind, part_id::INTEGER AS part_id FROM ranked JOIN sided USING (k)""")
def deck_contacts(s, d):
    """A contact of each nation's part with the parts of its region, and one of its suppliers as nodes with a segment."""
    k, nation = F.col("n_nationkey"), T.read(s, d, "nation")
    line = lambda *of: F.array(F.concat_ws(",", *(c.cast("string") for c in of)))
    zero = F.lit(0)
    surfaces = _cards(nation, k, F.array(F.lit("*CONTACT_AUTOMATIC_SURFACE_TO_SURFACE")), line(k + 1, F.col("n_regionkey") + 20, F.lit(3), F.lit(2)), line(zero, zero))
    tied = _cards(nation, k + 1000, F.array(F.lit("*CONTACT_TIED_TITLE"), F.lit("a title")), line(k + 100, k + 200, F.lit(4), zero))
    region = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(k + 1)).alias("ids"))
    parts = _cards(region, F.col("n_regionkey") + 2000, F.array(F.lit("*SET_PART_COLUMN")), line(F.col("n_regionkey") + 20), F.transform("ids", lambda i: i.cast("string")))
    held = T.read(s, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("ids"))
    nodes = _cards(held, F.col("s_nationkey") + 3000, F.array(F.lit("*SET_NODE_COLUMN")), line(F.col("s_nationkey") + 100), F.transform("ids", lambda i: i.cast("string")))
    segments = _cards(nation, k + 4000, F.array(F.lit("*SET_SEGMENT")), line(k + 200), line(k, k + 1, k + 2, k + 3))
    path = _text(surfaces.union(tied).union(parts).union(nodes).union(segments))
    elements = T.read(s, d, "supplier").select(F.col("s_nationkey").alias("part_id"), F.array(F.col("s_suppkey").cast("int"), (F.col("s_suppkey") + 1).cast("int")).alias("node_ids"))
    return text.contact_sides(s, path, text.keyword_sets(s, path), elements)


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT node_id, round(x + 2 * 0.25, 6) AS x, round(y + 2 * (y / 2 - y), 6) AS y, round(z, 6) AS z FROM nodes")
def deck_deformed_nodes(s, d):
    moved = T.nodes(s, d).select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), (F.col("x") + 0.25).alias("x"), (F.col("y") / 2).alias("y"), "z")
    path = new_path(s)
    sinks.write_deck(sinks.keyword_deformed(moved, 2.0), "*NODE", path)
    return rounded(text.keyword_nodes(s, path))


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT node_id, printf('%10d%10.3e%10.3e%10.3e', node_id, x * 10, y - 3, z) AS velocity, printf('%8d%16.8e%16.8e%16.8e', node_id, 0.25::DOUBLE, y - 1, 0.0::DOUBLE) AS displacement FROM nodes")
def deck_velocities_and_displacements(s, d):
    n = T.nodes(s, d)
    v = sinks.keyword_velocities(n.select("node_id", (F.col("x") * 10).alias("vx"), (F.col("y") - 3).alias("vy"), F.col("z").alias("vz"))).withColumnRenamed("value", "velocity")
    u = sinks.keyword_displacements(n.select("node_id", F.lit(0.25).alias("x"), F.lit(0.0).alias("x0"), F.col("y"), F.lit(1.0).alias("y0"), F.lit(2.0).alias("z"), F.lit(2.0).alias("z0"))).withColumnRenamed("value", "displacement")
    return v.join(u, "node_id")


@query(f"WITH {T.ES} SELECT element_id AS node_id, printf('%10d%10d', element_id, 1) || chr(10) || printf('%10.3e%10.3e%10.3e%10.3e%10.3e%10.3e%10.3e', sxx * 10, sxx, sxx / 4, 0.0::DOUBLE, -sxx, 1.0::DOUBLE, 2.0::DOUBLE) AS value FROM es WHERE row_line = 1 AND sxx > 40")
def deck_initial_stresses(s, d):
    e = T.element_states(s, d).where("row_line = 1 and sxx > 40")
    return sinks.keyword_stresses(e.select("element_id", (F.col("sxx") * 10).alias("sxx"), F.col("sxx").alias("syy"), (F.col("sxx") / 4).alias("szz"), F.lit(0.0).alias("txy"), (-F.col("sxx")).alias("tyz"), F.lit(1.0).alias("tzx"), F.lit(2.0).alias("eps")))


@query(f"WITH {T.SOLIDS}, {T.NODES} SELECT 'point' AS kind, node_id::BIGINT AS i, printf('%g', x) || ' ' || printf('%g', y) AS value, NULL::INTEGER AS cell_type FROM nodes UNION ALL SELECT 'cell', elem_idx, '8 ' || array_to_string(node_ids, ' '), 12 FROM solids")
def vtk_lines(s, d):
    flat = T.nodes(s, d).select(F.col("node_id").alias("node_idx"), *(F.regexp_replace(F.format_string("%s", F.col(c)), r"\.0$", "").alias(c) for c in "xyz"))
    points = sinks.vtk_points(T.nodes(s, d).withColumnRenamed("node_id", "node_idx")).join(flat, "node_idx").select(F.lit("point").alias("kind"), F.col("node_idx").cast("long").alias("i"), F.concat_ws(" ", "x", "y").alias("value"), F.lit(None).cast("int").alias("cell_type"))
    cells = sinks.vtk_cells(T.solids(s, d)).select(F.lit("cell").alias("kind"), F.col("elem_idx").cast("long").alias("i"), "value", "cell_type")
    return points.union(cells)


# Logs, series and sidecars

@query("SELECT n_nationkey * 0.001::DOUBLE AS t, (n_nationkey * 2)::DOUBLE AS ke, (n_nationkey + 1)::DOUBLE AS ie, 0.5::DOUBLE AS hourglass, (n_nationkey * 3 + 1.5)::DOUBLE AS total FROM nation")
def energy_log(s, d):
    k = F.col("n_nationkey")
    block = F.array(F.lit(" dt of cycle 1 is controlled by shell 3"), *(F.format_string(" %s%.5E", F.lit(name), v.cast("double")) for name, v in (("time...........................   ", k * 0.001), ("kinetic energy................   ", k * 2), ("internal energy...............   ", k + 1), ("hourglass energy .............   ", F.lit(0.5)), ("total energy..................   ", k * 3 + 1.5))))
    path = _text(_cards(T.read(s, d, "nation"), k, block))
    return text.energy_log(s, path).select("t", "ke", "ie", "hourglass", "total")


def _series(s: SparkSession, d: str) -> str:
    series = P.part_state_statistics(T.element_states(s, d).where("part_id = 3"), ["y_stress"])
    path = new_path(s)
    named = series.select(F.col("time").alias("Time"), F.col("y_stress_max").alias("Max_y_stress"), F.col("y_stress_min").alias("Min_y_stress"), F.col("y_stress_avg").alias("Avg_y_stress"), F.col("y_stress_max_element").alias("Max_Element_ID"))
    sinks.write_csv(named, path, 12)
    return path


@query(f"WITH {T.ES} SELECT round(time, 6) AS time, round(max(syy), 6) AS max, round(min(syy), 6) AS min, round(avg(syy), 6) AS avg, arg_max(element_id, (syy, -element_id))::INTEGER AS max_element FROM es WHERE part_id = 3 GROUP BY state_idx, time")
def part_series_csv(s, d):
    return rounded(text.series_csv(s, _series(s, d)).select("time", "max", "min", "avg", "max_element"))


MOTION = "m AS (SELECT event_id * 0.001::DOUBLE AS time, user_id % 4 AS part, round(value * 10, 3) AS acc, value AS disp FROM events WHERE event_id < 400)"


@query(f"WITH {MOTION} SELECT part::VARCHAR AS part, round(max(acc) / 9806.65, 6) AS peak_g, round(arg_min(time, (-acc, time)), 6) AS t_peak_g, round(max(CASE WHEN disp < 100 THEN disp END), 6) AS peak_displacement FROM m GROUP BY 1")
def part_motion_csv(s, d):
    """A file for each part; displacements that are not finite, here those over 100, do not count."""
    root = new_path(s)
    e = T.read(s, d, "events").where("event_id < 400").select((F.col("event_id") * 0.001).alias("Time"), (F.col("user_id") % 4).alias("part"), F.round(F.col("value") * -10, 3).alias("Avg_Acc_Mag"), F.when(F.col("value") < 100, F.col("value").cast("string")).otherwise("inf").alias("Max_Disp_Mag"))
    e.repartition("part").write.partitionBy("part").option("header", True).csv(root)
    found = text.motion_csv(s, f"{root}/*/").withColumn("part", F.regexp_extract("file", "part=([0-9]+)", 1))
    return rounded(text.motion_peaks(found, "part"))


@query("SELECT 'run_' || r_regionkey AS run, CASE r_regionkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'error' ELSE 'running' END AS status FROM region")
def run_terminations(s, d):
    root = new_path(s)
    said = F.when(F.col("n_regionkey") % 3 == 0, " N o r m a l   t e r m i n a t i o n").when(F.col("n_regionkey") % 3 == 1, " E r r o r   t e r m i n a t i o n").otherwise(" still going")
    for r in range(T.read(s, d, "region").count()):
        _text(s.range(1).select(F.lit(r).alias("n_regionkey")).select(F.lit(0).alias("n"), F.concat(F.lit("cycle 5\n"), said).alias("value")), f"{root}/run_{r}")
    return text.terminations(s, f"{root}/*").select(F.regexp_extract("file", "(run_[0-9]+)", 1).alias("run"), "status")


@query("SELECT 'run_' || r_regionkey AS run, true AS has_results FROM region")
def run_folders(s, d):
    root = new_path(s)
    for r in range(T.read(s, d, "region").count()):
        binary.write_bytes(f"{root}/run_{r}/resultplot", b"x" * (r + 1), [])
    return text.runs(s, root).select("run", "has_results")


@query(f"WITH {T.CELLS} SELECT 'impact' AS kind, key, round(g, 6) AS g, round(s3, 6) AS s3, 'too short' AS trust_reason, trust_ok, behavior FROM cells WHERE rev = 2")
def report_sidecars(s, d):
    root, own = new_path(s), T.cells(s, d).where("rev = 2")
    cells = F.collect_list(F.struct("key", F.col("category"), "g", "s3", "trust_ok", F.lit("too short").alias("trust_reason"), "behavior"))  # one report's cells
    own.groupBy("nation").agg(cells.alias("cells")).repartition("nation").write.partitionBy("nation").json(root)
    return rounded(text.sidecars(s, f"{root}/*").select("kind", "key", "g", "s3", "trust_reason", "trust_ok", "behavior"))


# Result writers

@query(f"WITH {T.ES} SELECT element_id, part_id, state_idx AS state, printf('%.6f', time) AS time, printf('%.6f', sxx) AS sxx, printf('%.6f', tyz) AS tyz FROM es")
def query_csv(s, d):
    path = new_path(s)
    sinks.write_query_csv(T.element_states(s, d), ["tyz", "sxx"], path)
    return s.read.option("header", True).csv(path).select(F.col("element_id").cast("long"), F.col("part_id").cast("long"), F.col("state").cast("int"), "time", "sxx", "tyz")


@query(f"WITH {T.ES} SELECT 'sxx' AS quantity, round(min(sxx), 6) AS min, round(max(sxx), 6) AS max, round(avg(sxx), 6) AS mean, count(sxx) AS count, 'mm' AS unit, (SELECT count(*) FROM es) AS documents FROM es UNION ALL SELECT 'eps', round(min(eps), 6), round(max(eps), 6), round(avg(eps), 6), count(eps), 'mm', (SELECT count(*) FROM es) FROM es")
def result_json(s, d):
    path = new_path(s)
    sinks.write_result_json(T.element_states(s, d), ["sxx", "eps"], path, {"unit": "mm"})
    unit = s.read.json(f"{path}/metadata").where("key = 'unit'").select(F.col("value").alias("unit"))
    return rounded(s.read.json(f"{path}/statistics").crossJoin(F.broadcast(unit)).withColumn("documents", F.lit(s.read.json(f"{path}/data").count()).cast("long")).select("quantity", "min", "max", "mean", "count", "unit", "documents"))  # one row


@query(f"WITH {T.ES} SELECT state_idx, count(*) AS n, round(sum(sxx), 4) AS sxx FROM es WHERE state_idx IN (3, 40) GROUP BY 1")
def result_parquet_by_state(s, d):
    path = new_path(s)
    sinks.write_parquet(T.element_states(s, d), path)
    return rounded(s.read.parquet(path).where("state_idx in (3, 40)").groupBy("state_idx").agg(F.count("*").alias("n"), F.sum("sxx").alias("sxx")), 4)


@query(f"WITH {T.ES}, g AS (SELECT part_id, time, max(syy) AS mx, avg(syy) AS av FROM es WHERE part_id IN (1, 2) GROUP BY 1, 2) SELECT printf('%.8f', time) AS time, coalesce(printf('%.8f', max(mx) FILTER (part_id = 1)), '') AS \"Part1_Max\", coalesce(printf('%.8f', max(mx) FILTER (part_id = 2)), '') AS \"Part2_Max\" FROM g GROUP BY g.time")
def wide_history_csv(s, d):
    path = new_path(s)
    sinks.write_wide_csv(P.part_state_statistics(T.element_states(s, d).where("part_id in (1, 2)"), ["y_stress"]), "y_stress", path)
    return s.read.option("header", True).csv(path).select("time", F.coalesce("Part1_Max", F.lit("")).alias("Part1_Max"), F.coalesce("Part2_Max", F.lit("")).alias("Part2_Max"))


@query("SELECT 's' || l_suppkey AS src, 'b' || p_brand AS dst, printf('%.6f', sum(l_quantity)) AS impulse, '1.500000' AS work, printf('%.6f', max(l_quantity)) AS peak_force FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def energy_flow_csv(s, d):
    rows = T.read(s, d, "lineitem").join(T.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    edges = rows.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("b"), F.col("p_brand")).alias("dst")).agg(F.sum("l_quantity").alias("impulse"), F.lit(1.5).alias("work"), F.max("l_quantity").alias("peak_force"))
    path = new_path(s)
    sinks.energy_flow_csv(edges, path)
    return s.read.option("header", True).csv(path)


@query("SELECT o_orderpriority AS section, count(DISTINCT o_custkey) AS runs, min(o_custkey) AS first, max(o_custkey) AS last FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def run_report(s, d):
    files = T.read(s, d, "orders").select(F.col("o_orderpriority").alias("section"), F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") != "F").alias("ok"))
    return sinks.run_report(files).select("section", "runs", F.element_at("run_ids", 1).alias("first"), F.element_at("run_ids", -1).alias("last"))


def _taken(s: SparkSession, d: str, columns: Column | None = None) -> DataFrame:
    from ..streaming import arrivals

    source, target = f"{new_path(s)}/in", new_path(s)
    own = T.element_states(s, d).select("part_id", "state_idx", "sxx")
    own.repartition(5).write.parquet(source)
    arrivals.each_batch(arrivals.states(s, source, own.schema, 2), lambda batch, i: batch.write.mode("overwrite").parquet(f"{target}/batch={i}"), new_path(s)).awaitTermination()
    return s.read.parquet(target)


@query(f"WITH {T.ES} SELECT part_id, count(*) AS n, round(max(sxx), 6) AS max, round(min(sxx), 6) AS min, round(avg(sxx), 6) AS mean, round(stddev_samp(sxx), 6) AS sd FROM es GROUP BY 1")
def states_taken_up_in_batches(s, d):
    """Files of states are taken up two at a time; what the batches wrote has every row once."""
    from ..streaming import arrivals

    return rounded(arrivals.part_extremes(_taken(s, d), "sxx"))

"""The engine's tables read from the driver's: element states, parts, series, DOE results, revisions, graphs.

Each view has its SQL beside it, which the oracle queries begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def element_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as states of elements: a part for each supplier, an element for each part, a state for each month."""
    t = read(spark, sf_dir, "lineitem")
    state = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("int")
    return t.select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("row_line"), F.col("l_suppkey").alias("part_id"), F.col("l_partkey").alias("element_id"), state.alias("state_idx"), (state * F.lit(0.001)).alias("time"),
        F.col("l_quantity").alias("sxx"), (F.col("l_extendedprice") / 1000).alias("syy"), (F.col("l_discount") * 100).alias("szz"), (F.col("l_tax") * 100).alias("txy"),
        (F.col("l_quantity") - 25).alias("tyz"), (F.col("l_discount") * F.col("l_quantity")).alias("tzx"), (F.col("l_tax") * F.col("l_discount")).alias("eps"),
    )


ES = """es AS (SELECT *, state_idx * 0.001 AS time FROM (SELECT l_orderkey AS row_id, l_linenumber AS row_line, l_suppkey AS part_id, l_partkey AS element_id,
  ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INTEGER AS state_idx,
  l_quantity AS sxx, l_extendedprice / 1000 AS syy, l_discount * 100 AS szz, l_tax * 100 AS txy, l_quantity - 25 AS tyz, l_discount * l_quantity AS tzx, l_tax * l_discount AS eps FROM lineitem))"""
#: von Mises and pressure of a row of es.
VM = "sqrt(0.5 * ((sxx-syy)*(sxx-syy) + (syy-szz)*(syy-szz) + (szz-sxx)*(szz-sxx)) + 3 * (txy*txy + tyz*tyz + tzx*tzx))"
PRESSURE = "-(sxx + syy + szz) / 3"


def part_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_size").alias("material_id"), F.col("p_retailprice").alias("mass"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


PARTS = "parts AS (SELECT p_partkey AS part_id, p_name AS name, p_size AS material_id, p_retailprice AS mass, p_brand AS brand, p_type AS kind FROM part)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_states(spark, sf_dir).select("state_idx", "time").distinct()


STATES = "st AS (SELECT DISTINCT state_idx, time FROM es)"


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: a key for each user, time in seconds."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("t"), "value", "event_type")


EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, event_type FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as points in space."""
    n = F.col("s_suppkey").cast("double")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_nationkey").alias("face"), (F.pmod(n * 37, F.lit(101.0)) - 50).alias("x"), (F.pmod(n * 53, F.lit(83.0)) - 40).alias("y"), F.pmod(n * 7, F.lit(16.0)).alias("z"), F.col("s_acctbal").alias("value"))


POINTS = "pts AS (SELECT s_suppkey AS point_id, s_nationkey AS face, (s_suppkey::DOUBLE * 37) % 101 - 50 AS x, (s_suppkey::DOUBLE * 53) % 83 - 40 AS y, (s_suppkey::DOUBLE * 7) % 16 AS z, s_acctbal AS value FROM supplier)"


def doe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOE results: faces are regions, positions suppliers, parts brands; the largest of each."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("face"))
    rows = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("face", F.col("l_suppkey").alias("pos_id"), F.col("p_brand").alias("part_id")).agg(F.max("l_extendedprice").alias("peak_g"), F.max("l_quantity").alias("peak_stress"), F.max("l_discount").alias("peak_strain"), F.max("l_tax").alias("peak_disp"))


DOE = """doe AS (SELECT n_regionkey AS face, l_suppkey AS pos_id, p_brand AS part_id, max(l_extendedprice) AS peak_g, max(l_quantity) AS peak_stress, max(l_discount) AS peak_strain, max(l_tax) AS peak_disp
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as revisions: a revision for each year, a cell for each nation and priority."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    grouped = o.groupBy((F.year("o_orderdate") - 1995).cast("int").alias("rev"), F.concat_ws("/", F.col("c_nationkey").cast("string"), F.col("o_orderpriority")).alias("key"), F.col("o_orderpriority").alias("category"), F.col("c_nationkey").alias("nation"))
    return grouped.agg(F.max("o_totalprice").alias("g"), F.min("c_acctbal").alias("s3"), F.max("o_orderstatus").alias("behavior"), (F.count("*") > 1).alias("trust_ok"))


CELLS = """cells AS (SELECT (year(o_orderdate) - 1995)::INTEGER AS rev, c_nationkey || '/' || o_orderpriority AS key, o_orderpriority AS category, c_nationkey AS nation,
  max(o_totalprice) AS g, min(c_acctbal) AS s3, max(o_orderstatus) AS behavior, count(*) > 1 AS trust_ok FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of hexahedra, 10 wide and deep: one for each supplier, with its nation as the part."""
    n = F.col("s_suppkey").cast("int")
    i, j, k = n % 10, F.floor(n / 10).cast("int") % 10, F.floor(n / 100).cast("int")
    at = lambda a, b, c: (i + a) + 11 * (j + b) + 121 * (k + c)
    corners = F.array(at(0, 0, 0), at(1, 0, 0), at(1, 1, 0), at(0, 1, 0), at(0, 0, 1), at(1, 0, 1), at(1, 1, 1), at(0, 1, 1))
    return read(spark, sf_dir, "supplier").select(F.lit("SOLID").alias("etype"), n.alias("elem_idx"), (n + 1).alias("elem_id"), F.col("s_nationkey").alias("part_id"), corners.alias("node_ids"))


SOLIDS = """so0 AS (SELECT s_suppkey::INTEGER AS n, s_nationkey AS part_id FROM supplier),
so1 AS (SELECT n, part_id, n % 10 AS i, (n // 10) % 10 AS j, n // 100 AS k FROM so0),
solids AS (SELECT n AS elem_idx, n + 1 AS elem_id, part_id, [i + 11*j + 121*k, i+1 + 11*j + 121*k, i+1 + 11*(j+1) + 121*k, i + 11*(j+1) + 121*k, i + 11*j + 121*(k+1), i+1 + 11*j + 121*(k+1), i+1 + 11*(j+1) + 121*(k+1), i + 11*(j+1) + 121*(k+1)] AS node_ids FROM so1)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the block, a little bent."""
    each = solids(spark, sf_dir).select(F.explode("node_ids").alias("node_id")).distinct()
    i, j, k = F.col("node_id") % 11, F.floor(F.col("node_id") / 11).cast("int") % 11, F.floor(F.col("node_id") / 121).cast("int")
    return each.select("node_id", (i * 1.0).alias("x"), (j * 1.5).alias("y"), (k * 2.0 + i * j * 0.01).alias("z"))


NODES = """nd0 AS (SELECT DISTINCT unnest(node_ids) AS node_id FROM solids),
nodes AS (SELECT node_id, (node_id % 11) * 1.0::DOUBLE AS x, ((node_id // 11) % 11) * 1.5::DOUBLE AS y, (node_id // 121) * 2.0::DOUBLE + (node_id % 11) * ((node_id // 11) % 11) * 0.01::DOUBLE AS z FROM nd0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An energy graph: suppliers and brands, with the quantity of each pair as the impulse."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("b"), F.col("p_brand")).alias("dst")).agg(F.sum("l_quantity").alias("impulse"))


def forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as contact forces: a run for every third user, seven contacts, sides -1 (in run 0 alone), 0 and 1; the fifth contact has all but no force on side 0."""
    e = read(spark, sf_dir, "events")
    run, contact = (F.col("user_id") % 3).cast("int"), (F.floor(F.col("user_id") / 3) % 7).cast("int")
    side = F.when((F.col("event_id") % 5 == 0) & (run == 0), -1).otherwise((F.floor(F.col("event_id") / 5) % 2).cast("int"))
    size = F.when((contact == 5) & (side == 0), F.col("value") * 1e-5).otherwise(F.col("value"))
    return e.select(run.alias("run_id"), contact.alias("interface_id"), side.alias("side"), (F.col("event_id") * 0.001).alias("t"), size.alias("fx"), (-size / 2).alias("fy"), F.when((contact == 5) & (side == 0), 0.0).otherwise((F.col("event_id") % 11) * 0.5).alias("fz"))


FORCES = """fo0 AS (SELECT (user_id % 3)::INTEGER AS run_id, ((user_id // 3) % 7)::INTEGER AS interface_id, event_id, value, CASE WHEN event_id % 5 = 0 AND user_id % 3 = 0 THEN -1 ELSE ((event_id // 5) % 2)::INTEGER END AS side FROM events),
fo1 AS (SELECT *, CASE WHEN interface_id = 5 AND side = 0 THEN value * 1e-5::DOUBLE ELSE value END AS size FROM fo0),
forces AS (SELECT run_id, interface_id, side, event_id * 0.001::DOUBLE AS t, size AS fx, -size / 2 AS fy, CASE WHEN interface_id = 5 AND side = 0 THEN 0.0::DOUBLE ELSE (event_id % 11) * 0.5::DOUBLE END AS fz FROM fo1)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories: a run for each user; every seventh never touches, and courses differ by the user."""
    e = read(spark, sf_dir, "events")
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    late = F.when(i > F.lit(0.5) * F.max("event_id").over(Window.partitionBy("user_id")), 1.0).otherwise(0.0)
    vz = F.when(late == 0, -20.0 - (i % 3)).otherwise((u % 9) * 2.5 - 5)
    ke = F.when(late == 0, 400.0 + (i % 5)).otherwise(404.0 * ((u % 11) / 10))
    return e.select(
        u.alias("run_id"), (i * 0.001).alias("t"), (v / 100).alias("pos_x"), ((i % 7) * 1.0).alias("pos_y"), (10.0 - (i % 13)).alias("pos_z"),
        (late * (u % 4) * 3.0).alias("vel_x"), (late * (u % 2)).alias("vel_y"), vz.alias("vel_z"), ke.alias("ke"), ((late == 1) & (u % 7 != 0)).alias("contact_engaged"),
    )


TRAJECTORIES = """tr0 AS (SELECT user_id AS u, event_id AS i, value AS v, CASE WHEN event_id > 0.5 * max(event_id) OVER (PARTITION BY user_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS late FROM events),
trajectories AS (SELECT u AS run_id, i * 0.001::DOUBLE AS t, v / 100 AS pos_x, (i % 7) * 1.0::DOUBLE AS pos_y, 10.0::DOUBLE - (i % 13) AS pos_z, late * (u % 4) * 3.0::DOUBLE AS vel_x, late * (u % 2) AS vel_y,
  CASE WHEN late = 0 THEN -20.0::DOUBLE - (i % 3) ELSE (u % 9) * 2.5::DOUBLE - 5 END AS vel_z, CASE WHEN late = 0 THEN 400.0::DOUBLE + (i % 5) ELSE 404.0::DOUBLE * ((u % 11) / 10.0::DOUBLE) END AS ke, late = 1 AND u % 7 <> 0 AS contact_engaged FROM tr0)"""


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as energy logs: a run for each user."""
    i, v = F.col("event_id"), F.col("value")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (i * 0.001).alias("t"), v.alias("ke"), (v / 2).alias("ie"), (v * (i % 3) / 20).alias("hourglass"), (v * (i % 7) / 60).alias("sliding"), (v + 400 + i % 13).alias("total"))


ENERGIES = "energies AS (SELECT user_id AS run_id, event_id * 0.001::DOUBLE AS t, value AS ke, value / 2 AS ie, value * (event_id % 3) / 20 AS hourglass, value * (event_id % 7) / 60 AS sliding, value + 400 + event_id % 13 AS total FROM events)"

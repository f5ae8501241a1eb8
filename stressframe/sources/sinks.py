"""Sinks: results as CSV, JSON and Parquet, keyword decks, VTK text, histories."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: str, digits: int) -> Column:
    """A number with so many decimals; NULL stays NULL."""
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).alias(c)


def write_csv(df: DataFrame, path: str, digits: int = 6, delimiter: str = ",", order: Sequence[str] = ()) -> None:
    """CSV with a header, fixed decimals, and blanks for what is missing."""
    rows = df.select(*(fixed(f.name, digits) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))
    rows = rows.orderBy(*order) if order else rows
    rows.write.mode("overwrite").option("header", True).option("sep", delimiter).option("nullValue", "").option("emptyValue", "").csv(path)


def write_query_csv(result: DataFrame, quantities: Sequence[str], path: str) -> None:
    write_csv(result.select("element_id", "part_id", F.col("state_idx").alias("state"), "time", *sorted(quantities)), path)


def write_json(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """A document for each row; metadata, if any, goes into each."""
    for k, v in (metadata or {}).items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("overwrite").json(path)


def statistics_block(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The statistics that go with results: a row for each column with min, max, mean, count."""
    pairs = F.array(*(F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("v")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("quantity").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("v").alias("count"))


def write_result_json(df: DataFrame, columns: Sequence[str], path: str, metadata: dict[str, str] | None = None) -> None:
    """Results as JSON: folders ``data`` (a document for each row) and ``statistics`` (one for each column), and ``metadata``."""
    write_json(df, f"{path}/data")
    write_json(statistics_block(df, columns), f"{path}/statistics")
    spark = df.sparkSession
    write_json(spark.createDataFrame(sorted((metadata or {}).items()), "key string, value string"), f"{path}/metadata")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ("state_idx",)) -> None:
    """Parquet in folders by state, so that a query of some states reads only these."""
    keys = [c for c in by if c in df.columns]
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path) if keys else df.write.mode("overwrite").parquet(path)


def write_wide_csv(series: DataFrame, quantity: str, path: str) -> None:
    """time, then Part<id>_Max, _Min and _Avg, eight decimals."""
    from ..operators.parts import wide

    write_csv(wide(series, quantity), path, 8)


def part_summary(series: DataFrame, quantity: str) -> DataFrame:
    """A line for each part: extremes over all states and their times."""
    from ..operators.parts import global_extremes

    return global_extremes(series, quantity)


def _card(width: int, c: str, kind: str) -> Column:
    return F.format_string(f"%{width}{kind}", F.col(c))


def _numbers(width: int, digits: int, *columns: Column) -> Column:
    """Numbers side by side as C prints them, from their exact values: Java rounds the shortest decimal, which makes 100.05 (a little less in binary) 1.001e+02."""
    form, none = f"%{width}.{digits}e", "null".rjust(width)

    def shown(*of: pa.Array) -> pa.Array:
        return pa.array(["".join(none if v is None else form % v for v in row) for row in zip(*(a.to_pylist() for a in of), strict=True)], pa.string())

    return F.arrow_udf(shown, "string")(*(c.cast("double") for c in columns))


def keyword_nodes(nodes: DataFrame) -> DataFrame:
    """value: *NODE lines of places, eight and sixteen columns wide."""
    return nodes.select("node_id", F.concat(_card(8, "node_id", "d"), _numbers(16, 8, *map(F.col, "xyz"))).alias("value"))


def keyword_velocities(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.concat(_card(10, "node_id", "d"), _numbers(10, 3, *map(F.col, ("vx", "vy", "vz")))).alias("value"))


def keyword_stresses(states: DataFrame) -> DataFrame:
    """Initial stresses of solids: a line of the element, then six components and the plastic strain."""
    head = F.format_string("%10d%10d", F.col("element_id"), F.lit(1))
    body = _numbers(10, 3, *map(F.col, ("sxx", "syy", "szz", "txy", "tyz", "tzx", "eps")))
    return states.select(F.col("element_id").alias("node_id"), F.concat(head, F.lit("\n"), body).alias("value"))


def write_deck(rows: DataFrame, card: str, path: str) -> None:
    """A keyword deck in parts: each file begins with the card and has whole lines in order of id."""
    ordered = rows.repartitionByRange("node_id").sortWithinPartitions("node_id")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
    ordered.select(F.when(first, F.concat(F.lit(f"*KEYWORD\n{card}\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def keyword_deformed(nodes: DataFrame, scale: float = 1.0) -> DataFrame:
    """value: *NODE lines of deformed places: x0, y0, z0 and so many times the displacement."""
    return keyword_nodes(nodes.select("node_id", *((F.col(f"{c}0") + scale * (F.col(c) - F.col(f"{c}0"))).alias(c) for c in "xyz")))


def keyword_displacements(nodes: DataFrame) -> DataFrame:
    """value: lines of displacements, eight and sixteen columns wide."""
    return nodes.select("node_id", F.concat(_card(8, "node_id", "d"), _numbers(16, 8, *(F.col(c) - F.col(f"{c}0") for c in "xyz"))).alias("value"))


def vtk_points(nodes: DataFrame) -> DataFrame:
    """value: point lines of a legacy VTK grid, in order of index."""
    return nodes.select("node_idx", F.concat_ws(" ", *(F.format_string("%.9g", F.col(c)) for c in "xyz")).alias("value"))


#: VTK cell types.
VTK_CELLS = {"SOLID": 12, "THICK_SHELL": 12, "SHELL": 9, "BEAM": 3}


def vtk_cells(elements: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(v) for kv in VTK_CELLS.items() for v in kv))
    return elements.select("etype", "elem_idx", F.concat_ws(" ", F.size("node_ids").cast("string"), F.transform("node_ids", lambda i: i.cast("string"))).alias("value"), kinds[F.col("etype")].alias("cell_type"))


def write_vtk(nodes: DataFrame, elements: DataFrame, path: str, title: str = "mesh") -> None:
    """A legacy VTK grid, one file in a folder: a point in a line, in order of node_idx, then cells by class and index, then their types."""
    cells = vtk_cells(elements).withColumn("rank", F.concat_ws("/", "etype", F.format_string("%012d", "elem_idx")))
    n, m, words = nodes.count(), elements.count(), elements.agg(F.coalesce(F.sum(F.size("node_ids") + 1), F.lit(0))).first()[0]
    head = [f"# vtk DataFile Version 3.0\n{title}\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double", f"CELLS {m} {words}", f"CELL_TYPES {m}"]
    rows = nodes.sparkSession.createDataFrame([(k, "", h) for k, h in zip((0, 2, 4), head, strict=True)], "part int, rank string, value string")
    rows = rows.union(vtk_points(nodes).select(F.lit(1), F.format_string("%012d", "node_idx"), "value")).union(cells.select(F.lit(3), "rank", "value")).union(cells.select(F.lit(5), "rank", F.col("cell_type").cast("string")))
    rows.coalesce(1).sortWithinPartitions("part", "rank").select("value").write.mode("overwrite").text(path)


def energy_flow_csv(edges: DataFrame, path: str) -> None:
    write_csv(edges.select("src", "dst", "impulse", "work", "peak_force"), path, 6, order=("src", "dst"))


def run_report(files: DataFrame) -> DataFrame:
    """Rendered files of successful runs by section: section, runs, and the ids of the runs."""
    return files.where("ok").groupBy("section").agg(F.count_distinct("run_id").alias("runs"), F.array_sort(F.collect_set("run_id")).alias("run_ids"))

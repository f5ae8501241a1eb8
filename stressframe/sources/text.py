"""Text sources: keyword decks, energy logs, series files, run folders, report sidecars.

Text files are split by Spark like any other. The rows of a split stand in order, so a line's
place is the split's place in its file and its own in the split; what a split must know of the
splits before it (how many lines, which card is open) is a row for each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most splits whose rows are broadcast; of more, they are joined like any table.
BROADCAST_SPLITS = 100_000


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where a line's split begins), at (increasing by one within a split) and value of each line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with what is known of their splits; ``blocks`` has a row for each, counted before it is broadcast."""
    few = blocks.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    return rows.join(F.broadcast(blocks) if few else blocks, ["file", "block"])


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, n (from 0) and value of each line; a split knows how many lines stand before it."""
    rows = _raw(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for a split
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("size")).select("file", "block", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return _with_blocks(rows, blocks).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("n"), "value")


def included(spark: SparkSession, path: str) -> list[str]:
    """The files of a deck: its own, and those that *INCLUDE cards name, in them too, each once; names are relative to the deck's folder."""
    folder, found, waiting = path.rsplit("/", 1)[0], [], [path]
    while waiting:
        now = [p for p in dict.fromkeys(waiting) if p not in found]
        found += now
        if not now:
            break
        rows = cards(spark, now).where(F.col("card").rlike(r"^\*INCLUDE(_[A-Z]+)?$")).where("i = 0").select(F.trim("value").alias("name"))
        waiting = [r["name"] if r["name"].startswith("/") or "://" in r["name"] else f"{folder}/{r['name']}" for r in rows.distinct().collect()]  # a row for each card
    return found


class _Scan:
    """Lines of a partition under the heads of their splits, batch by batch: what is open goes on to the next batch."""

    def __init__(self):
        self.key, self.card, self.card_at, self.i, self.ended = None, None, None, 0, False

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        """file, block, at, card, card_at, i, ended, value of lines without comments; heads have i = -1; card is None before the first head of a split."""
        value = frame["value"].to_numpy(object)
        keep = np.array([not v.startswith("$") for v in value], bool)
        frame, value = frame[keep], value[keep]
        n = len(frame)
        if not n:
            return frame.assign(card=None, card_at=None, i=0, ended=False)
        file, block = frame["file"].to_numpy(object), frame["block"].to_numpy()
        fresh = np.empty(n, bool)
        fresh[0] = (file[0], block[0]) != self.key
        fresh[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        head = np.array([v.startswith("*") for v in value], bool)
        place, at = np.arange(n), frame["at"].to_numpy()
        card, card_at, i, ended = np.empty(n, object), np.empty(n, object), np.empty(n, np.int64), np.empty(n, bool)
        for a, b in zip(marks := np.flatnonzero(fresh | head | (place == 0)), [*marks[1:], n], strict=True):
            if fresh[a]:
                self.card, self.card_at, self.i, self.ended = None, None, 0, False
            if head[a]:
                self.card, self.card_at, self.i = value[a].strip().upper(), int(at[a]), -1
                self.ended = self.ended or self.card == "*END"
            card[a:b], card_at[a:b], ended[a:b] = self.card, self.card_at, self.ended
            i[a:b] = self.i + np.arange(b - a)
            self.i += b - a
        self.key = (file[-1], block[-1])
        return pd.DataFrame({"file": file, "block": block, "at": at, "card": card, "card_at": pd.array(card_at, "Int64"), "i": i, "ended": ended, "value": value})


def _under_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scan = _Scan()
    for frame in frames:
        out = scan(frame)
        yield out[(out["i"] >= 0) & ~out["ended"].astype(bool)][["file", "block", "card", "card_at", "i", "value"]]


def _of_splits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each split: the card that is open at its end, if it has a head, its lines since then, and whether the deck ended."""
    scan, last = _Scan(), None
    for frame in frames:
        out = scan(frame)
        if len(out):
            both = out if last is None else pd.concat([last, out])
            ends = both.drop_duplicates(["file", "block"], keep="last")
            yield ends.iloc[:-1].assign(tail=lambda x: x["i"] + 1)[_SPLIT]
            last = ends.iloc[-1:]
    if last is not None:
        yield last.assign(tail=lambda x: x["i"] + 1)[_SPLIT]


_SPLIT = ["file", "block", "card", "card_at", "tail", "ended"]


def cards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines under their card's name, without comments and what follows *END: file, card, card_n (in order within a file), i, value.

    No line is shuffled: each split numbers its own, and what stands above its first head
    belongs to the card that the splits before it left open.
    """
    rows = _raw(spark, path)
    splits = rows.mapInPandas(_of_splits, "file string, block long, card string, card_at long, tail long, ended boolean")
    order = Window.partitionBy("file").orderBy("block")  # a row for a split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumns({"opened": F.sum(F.col("card").isNotNull().cast("int")).over(order), "from": F.when(F.col("card").isNotNull(), F.struct("block", F.col("card_at").alias("at")))})
    summed = F.sum("tail").over(Window.partitionBy("file", "opened").orderBy("block"))
    blocks = known.withColumn("sum", summed).select(
        "file", "block", F.last("card", True).over(before).alias("open"), F.last("from", True).over(before).alias("open_n"),
        F.lag("sum").over(order).alias("open_i"), F.coalesce(F.max("ended").over(before), F.lit(False)).alias("over"),
    )
    under = rows.mapInPandas(_under_heads, "file string, block long, card string, card_at long, i long, value string")
    own = F.col("card").isNotNull()
    out = _with_blocks(under, blocks).where(~F.col("over"))
    named = out.select("file", F.coalesce("card", "open").alias("card"), F.when(own, F.struct("block", F.col("card_at").alias("at"))).otherwise(F.col("open_n")).alias("card_n"), F.when(own, F.col("i")).otherwise(F.col("i") + F.col("open_i")).alias("i"), "value")
    return named.where("card is not null")


def fields(value, widths: list[int]):
    """Fields of a line: by commas if it has any, else by widths; empty ones NULL."""
    edges = [sum(widths[:i]) for i in range(len(widths))]
    fixed = F.array(*(F.substring(value, a + 1, w) for a, w in zip(edges, widths, strict=True)))
    return F.transform(F.when(value.contains(","), F.split(value, ",")).otherwise(fixed), lambda s: F.nullif(F.trim(s), F.lit("")))


def number(c):
    """A number as written by hand or by Fortran (1.5D+03, 1.5+3)."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "[dD]", "e"), r"(?<=[0-9.])([+-]\d+)$", "e$1")
    return t.try_cast("double")


def keyword_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, x, y, z of *NODE cards."""
    f = fields(F.col("value"), [8, 16, 16, 16])
    rows = cards(spark, path).where("card = '*NODE'").select(f.alias("f"))
    return rows.select(F.get("f", F.lit(0)).try_cast("int").alias("node_id"), *(number(F.get("f", F.lit(i + 1))).alias(c) for i, c in enumerate("xyz")))


def keyword_elements(spark: SparkSession, path: str) -> DataFrame:
    """etype, elem_id, part_id, node_ids of *ELEMENT_SOLID, _SHELL and _BEAM cards."""
    f = fields(F.col("value"), [8] * 10)
    rows = cards(spark, path).where(F.col("card").rlike(r"^\*ELEMENT_(SOLID|SHELL|BEAM|TSHELL)")).select("card", f.alias("f"))
    ids = F.transform(F.filter(F.slice("f", 3, 8), lambda s: s.isNotNull()), lambda s: s.try_cast("int"))
    kind = F.regexp_extract("card", r"^\*ELEMENT_(SOLID|SHELL|BEAM|TSHELL)", 1)
    out = rows.select(F.when(kind == "TSHELL", "THICK_SHELL").otherwise(kind).alias("etype"), F.get("f", F.lit(0)).try_cast("int").alias("elem_id"), F.get("f", F.lit(1)).try_cast("int").alias("part_id"), F.filter(ids, lambda i: i != 0).alias("node_ids"))
    return out.withColumn("node_ids", F.when(F.col("etype") == "BEAM", F.slice("node_ids", 1, 2)).otherwise(F.col("node_ids")))


def keyword_sets(spark: SparkSession, path: str) -> DataFrame:
    """kind, set_id, ids, segments, warning of *SET cards.

    LIST has eight ids in a line, GENERATE pairs of ends, COLUMN the first field of a line,
    SEGMENT three or four nodes, GENERAL rows of NODE. _ADD cards and other rows of GENERAL
    give a warning and no set or ids.
    """
    rows = cards(spark, path).where(F.col("card").startswith("*SET_"))
    titled = rows.withColumn("i", F.col("i") - F.col("card").endswith("_TITLE").cast("int"))
    f = titled.select("file", "card", "card_n", "i", fields(F.col("value"), [10] * 8).alias("f")).where("i >= 0")
    kind = F.regexp_extract("card", r"^\*SET_([A-Z]+)", 1)
    first = f.where("i = 0").select("file", "card_n", F.get("f", F.lit(0)).try_cast("int").alias("set_id"))
    body = f.where("i > 0").withColumn("kind", kind).join(first, ["file", "card_n"])
    numbers = lambda c: F.filter(F.transform(c, lambda s: F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))), lambda v: v.isNotNull() & (v > 0))
    own = numbers(F.col("f"))
    generate = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 2).cast("int") - 1), lambda k: F.sequence(F.get(own, 2 * k), F.get(own, 2 * k + 1))))
    is_ = lambda s: F.col("card").contains(s)
    general = is_("_GENERAL")
    ids = F.when(is_("_ADD"), F.array().cast("array<int>")).when(F.col("kind") == "SEGMENT", F.array().cast("array<int>")).when(is_("_GENERATE"), F.when(F.size(own) >= 2, generate).otherwise(F.array().cast("array<int>"))).when(is_("_COLUMN"), F.slice(own, 1, 1)).when(general, F.when(F.upper(F.get("f", F.lit(0))) == "NODE", own).otherwise(F.array().cast("array<int>"))).otherwise(own)
    warn = F.when(is_("_ADD"), "card of sets of sets is skipped").when(general & (F.upper(F.get("f", F.lit(0))) != "NODE"), "row of this kind is skipped").when((F.col("kind") == "SEGMENT") & (is_("_GENERATE") | general), "segments of this kind are skipped")
    segment = F.when((F.col("kind") == "SEGMENT") & ~is_("_GENERATE") & ~general, F.slice(own, 1, 4))
    each = body.select("file", "card_n", "kind", "set_id", "i", ids.alias("ids"), segment.alias("segment"), warn.alias("warning"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "ids", "segment")))
    out = each.groupBy("file", "card_n", "kind", "set_id").agg(ordered.alias("o"), F.max("warning").alias("warning"))
    return out.select("kind", "set_id", F.flatten("o.ids").alias("ids"), F.filter("o.segment", lambda s: s.isNotNull()).alias("segments"), "warning")


def keyword_parts(spark: SparkSession, path: str) -> DataFrame:
    """part_id, name, section_id, material_id of *PART cards: a line of the name, then one of numbers."""
    rows = cards(spark, path).where("card = '*PART'").withColumn("pair", F.floor(F.col("i") / 2))
    f = fields(F.col("value"), [10] * 8)
    both = rows.groupBy("file", "card_n", "pair").agg(F.max(F.when(F.col("i") % 2 == 0, F.trim("value"))).alias("name"), F.max(F.when(F.col("i") % 2 == 1, f)).alias("f"))
    return both.where("f is not null").select(F.get("f", F.lit(0)).try_cast("int").alias("part_id"), "name", F.get("f", F.lit(1)).try_cast("int").alias("section_id"), F.get("f", F.lit(2)).try_cast("int").alias("material_id"))


def keyword_materials(spark: SparkSession, path: str) -> DataFrame:
    """material_id, card, density, modulus, ratio, yield_stress from the first line of *MAT cards."""
    rows = cards(spark, path).where(F.col("card").startswith("*MAT"))
    first = rows.withColumn("i", F.col("i") - F.col("card").endswith("_TITLE").cast("int")).where("i = 0").select("card", fields(F.col("value"), [10] * 8).alias("f"))
    names = ("density", "modulus", "ratio", "yield_stress")
    return first.select(F.get("f", F.lit(0)).try_cast("int").alias("material_id"), "card", *(number(F.get("f", F.lit(i + 1))).alias(n) for i, n in enumerate(names)))


def contact_sides(spark: SparkSession, path: str, sets: DataFrame, elements: DataFrame) -> DataFrame:
    """interface, side, kind, part_id of *CONTACT cards: sides that are parts or sets of parts, nodes or segments, resolved to parts."""
    rows = cards(spark, path).where(F.col("card").startswith("*CONTACT")).withColumn("i", F.col("i") - F.col("card").endswith("_TITLE").cast("int")).where("i = 0")
    f = fields(F.col("value"), [10] * 8)
    n = F.dense_rank().over(Window.orderBy("file", "card_n"))  # a row for each contact card
    at = lambda i: F.get("f", F.lit(i)).try_cast("int")
    sides = rows.select(n.alias("interface"), f.alias("f")).select("interface", F.inline(F.array(F.struct(F.lit(0).alias("side"), at(0).alias("id"), at(2).alias("kind")), F.struct(F.lit(1).alias("side"), at(1).alias("id"), at(3).alias("kind")))))
    kinds = F.create_map(*(F.lit(v) for kv in {0: "SEGMENT", 2: "PART", 4: "NODE"}.items() for v in kv))
    direct = sides.where("kind = 3").select("interface", "side", "kind", F.col("id").alias("part_id"))
    joined = sides.where("kind <> 3").join(sets.withColumnRenamed("kind", "set_kind"), (F.col("id") == F.col("set_id")) & (kinds[F.col("kind")] == F.col("set_kind")))
    of_parts = joined.where("kind = 2").select("interface", "side", "kind", F.explode("ids").alias("part_id"))
    node = F.explode(F.when(F.col("kind") == 0, F.flatten("segments")).otherwise(F.col("ids"))).alias("node_id")
    own = elements.select(F.explode("node_ids").alias("node_id"), "part_id").distinct()
    by_node = joined.where("kind in (0, 4)").select("interface", "side", "kind", node).join(own, "node_id").select("interface", "side", "kind", "part_id").distinct()
    return direct.union(of_parts).union(by_node)


def energy_log(spark: SparkSession, path: str) -> DataFrame:
    """cycle, t and energies of a text log: blocks under a 'time' line, 'name....value' lines."""
    rows = lines(spark, path)
    key = F.trim(F.regexp_replace(F.regexp_extract("value", r"^\s*([A-Za-z][^.]*?)\s*\.{2,}", 1), r"\s+", " "))
    value = number(F.regexp_extract("value", r"\.{2,}\s*([-+0-9.eEdD]+)\s*$", 1))
    w = Window.partitionBy("file").orderBy("n")
    found = rows.select("file", "n", F.lower(key).alias("k"), value.alias("v")).where("k <> '' and v is not null").withColumn("block", F.sum((F.col("k") == "time").cast("int")).over(w)).where("block > 0")
    names = {"time": "t", "kinetic energy": "ke", "internal energy": "ie", "hourglass energy": "hourglass", "sliding interface energy": "sliding", "total energy": "total", "time step": "dt"}
    return found.groupBy("file", "block").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in names.items()))


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, time, max, min, avg, max_element of part series; columns are found by their prefixes."""
    df = spark.read.option("header", True).csv(path)

    def pick(prefix: str):
        found = next((c for c in df.columns if c.lower().startswith(prefix) and not c.lower().endswith("_element_id")), None)
        return F.col(f"`{found}`").cast("double") if found else F.lit(None).cast("double")

    element = next((c for c in df.columns if c.lower().startswith("max_element")), None)
    return df.select(F.input_file_name().alias("file"), pick("time").alias("time"), pick("max_").alias("max"), pick("min_").alias("min"), pick("avg_").alias("avg"), (F.col(f"`{element}`").cast("int") if element else F.lit(None).cast("int")).alias("max_element"))


#: Columns of motion files.
MOTION = tuple(f"Avg_{kind}_{part}" for kind in ("Disp", "Vel", "Acc") for part in ("X", "Y", "Z", "Mag")) + ("Max_Disp_Mag",)
#: Fixed value: the standard gravity in mm/s2.
GRAVITY = 9806.65


def motion_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, time and the motion of a part: mean displacement, velocity and acceleration by axis and size, and the largest displacement; NULL for a column that is not there."""
    df = spark.read.option("header", True).csv(path)
    there = {c.lower(): c for c in df.columns}
    at = lambda c: F.col(f"`{there[c.lower()]}`").try_cast("double") if c.lower() in there else F.lit(None).cast("double")
    return df.select(F.input_file_name().alias("file"), at("Time").alias("time"), *(at(c).alias(c.lower()) for c in MOTION))


def motion_peaks(motion: DataFrame, by: str = "file") -> DataFrame:
    """Of each file: the largest mean acceleration in G and its time (ties: the first), and the largest finite displacement."""
    size, d = F.abs("avg_acc_mag"), F.col("max_disp_mag")
    finite = F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)
    return motion.groupBy(by).agg((F.max(size) / GRAVITY).alias("peak_g"), F.min_by("time", F.when(size.isNotNull(), F.struct(-size, "time"))).alias("t_peak_g"), F.max(finite).alias("peak_displacement"))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """run, folder and files of every folder below ``root`` that holds a result or a log, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.select(folder.alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length").groupBy("folder").agg(F.regexp_extract("folder", "[^/]*$", 0).alias("run"), F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max(F.col("name").rlike("(?i)(plot|\\.csv|\\.json)$")).alias("has_results"))


def terminations(spark: SparkSession, path: str) -> DataFrame:
    """file and status (normal, error or running) of run logs."""
    text = lines(spark, path).groupBy("file").agg(F.max(F.lower("value").rlike(r"n\s*o\s*r\s*m\s*a\s*l\s+t\s*e\s*r\s*m")).alias("ok"), F.max(F.lower("value").rlike(r"e\s*r\s*r\s*o\s*r\s+t\s*e\s*r\s*m")).alias("bad"))
    return text.select("file", F.when(F.col("bad"), "error").when(F.col("ok"), "normal").otherwise("running").alias("status"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (impact or sphere) and the cells of report files, one JSON document each."""
    numbers = ("x", "y", "roll", "pitch", "yaw", "g", "s", "e", "d", "s1", "s3", "e1", "e3", "evm", "ke_retention", "diss_pct", "max_penetration_depth")
    schema = f"kind string, cells array<struct<key:string,category:string,{','.join(f'{c}:double' for c in numbers)},trust_ok:boolean,trust_reason:string,behavior:string>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    kind = F.coalesce("kind", F.when(F.exists("cells", lambda c: c["roll"].isNotNull()), "sphere").otherwise("impact"))
    return df.select("file", kind.alias("kind"), F.inline("cells"))


def vtk_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node_idx, x, y, z of the points; elem_idx, cell_type, node_ids of the cells) of a legacy VTK text grid with a point or a cell in each line."""
    rows = lines(spark, path)
    head = F.regexp_extract("value", "^(POINTS|CELLS|CELL_TYPES|POINT_DATA|CELL_DATA)", 1)
    w = Window.partitionBy("file").orderBy("n")
    known = rows.withColumn("head", F.nullif(head, F.lit(""))).withColumns({"part": F.last("head", True).over(w), "start": F.last(F.when(F.col("head").isNotNull(), F.col("n")), True).over(w)})
    body = known.where("head is null and trim(value) <> ''").select("file", "part", (F.col("n") - F.col("start") - 1).alias("i"), F.split(F.trim("value"), r"\s+").alias("f"))
    points = body.where("part = 'POINTS'").select(F.col("i").alias("node_idx"), *(number(F.get("f", F.lit(k))).alias(c) for k, c in enumerate("xyz")))
    types = body.where("part = 'CELL_TYPES'").select("file", "i", F.get("f", F.lit(0)).try_cast("int").alias("cell_type"))
    cells = body.where("part = 'CELLS'").join(types, ["file", "i"])
    return points, cells.select(F.col("i").alias("elem_idx"), "cell_type", F.transform(F.slice("f", 2, F.size("f") - 1), lambda v: v.cast("int")).alias("node_ids"))

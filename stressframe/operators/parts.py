"""Statistics of parts over time, peak elements, and named sets.

Element tables are large, so every quantity is taken from one scan by one grouped
aggregation, of which each task does its part before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tensor import STRAIN, STRESS, with_face_stress, with_principals
from .extremes import at_largest, at_least, tie_of, with_extremes
from .select import QUANTITIES


def _ready(df: DataFrame, columns: list[str], ties: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` ready for extremes of columns with their element, and by which column each is told: rounded, where values alike to ``ties`` digits are to be ties."""
    by = {c: c if ties is None else f"__o_{c}" for c in columns}
    if ties is not None:
        df = df.withColumns({o: F.round(c, ties) for c, o in by.items()})
    return with_extremes(df, list(by.values()), F.col("element_id").cast("long")), by


def part_state_statistics(df: DataFrame, quantities: list[str], by: tuple[str, ...] = ("part_id", "state_idx"), ties: int | None = None) -> DataFrame:
    """Wide: max, min, avg, rms and the elements of the extremes of each quantity, in one pass by hashing; no rows are sorted.

    Of elements with the extreme value, to ``ties`` digits if that is given, the least counts.
    """
    ready, told = _ready(df.select(*by, "element_id", "time", *(QUANTITIES[q]().alias(q) for q in quantities)), quantities, ties)
    columns = [F.min("time").alias("time")]
    for q in quantities:
        columns += [F.max(q).alias(f"{q}_max"), F.min(q).alias(f"{q}_min"), F.avg(q).alias(f"{q}_avg"), F.sqrt(F.avg(F.col(q) * F.col(q))).alias(f"{q}_rms"), at_largest("element_id", told[q]).alias(f"{q}_max_element"), at_least("element_id", told[q]).alias(f"{q}_min_element")]
    return ready.groupBy(*by).agg(*columns)


def global_extremes(series: DataFrame, quantity: str) -> DataFrame:
    """Over all states of a part: largest and least value and the time of each."""
    return series.groupBy("part_id").agg(
        F.max(f"{quantity}_max").alias("global_max"), F.min(f"{quantity}_min").alias("global_min"),
        F.min_by("time", F.struct(-F.col(f"{quantity}_max"), "state_idx")).alias("time_of_max"), F.min_by("time", F.struct(F.col(f"{quantity}_min"), "state_idx")).alias("time_of_min"),
    )


def peak_elements(df: DataFrame, quantity: str, ties: int | None = None) -> DataFrame:
    """The element of each part with the largest value at any state, to ``ties`` digits if that is given (ties: the first state, the least element)."""
    value = QUANTITIES[quantity]()
    ready = df.select("part_id", "element_id", "state_idx", (value if ties is None else F.round(value, ties)).alias("peak")).where(F.col("peak").isNotNull())
    told = with_extremes(ready, ["peak"], tie_of(F.col("state_idx"), F.col("element_id")))
    return told.groupBy("part_id").agg(F.max("peak").alias("peak"), at_largest("element_id", "peak").alias("element_id"), at_largest("state_idx", "peak").alias("state_idx"))


def peak_tensor_history(df: DataFrame, quantity: str) -> DataFrame:
    """All states of each part's peak element, whole rows."""
    peaks = peak_elements(df, quantity).select("part_id", "element_id").distinct()
    return df.join(peaks, ["part_id", "element_id"], "left_semi")


def resolve_set(parts: DataFrame, ids: DataFrame, patterns: list[str], members: DataFrame) -> DataFrame:
    """part_id and found: explicit ids, names that match a pattern, and members of sets, against the parts there are."""
    named = parts.where(F.lit(False) if not patterns else F.col("name").rlike("(?i)" + "|".join(f"^(?:{p})$" for p in patterns))).select("part_id")
    wanted = ids.select("part_id").union(named).union(members.select("part_id")).distinct()
    return wanted.join(parts.select("part_id", F.lit(True).alias("__there")).distinct(), "part_id", "left").select("part_id", F.coalesce("__there", F.lit(False)).alias("found"))


def segment_parents(segments: DataFrame, solids: DataFrame, least_shared: int = 3) -> DataFrame:
    """Parent solid of each segment: the one that shares most of its nodes (ties: the least index), with ``least_shared`` at least."""
    s = segments.select("segment_id", F.explode(F.array_distinct("node_ids")).alias("node"))
    e = solids.select("elem_idx", F.explode(F.array_distinct("node_ids")).alias("node"))
    shared = s.join(e, "node").groupBy("segment_id", "elem_idx").count().where(F.col("count") >= least_shared)
    return shared.groupBy("segment_id").agg(F.min_by("elem_idx", F.struct(-F.col("count"), "elem_idx")).alias("elem_idx"), F.max("count").alias("shared"))


def set_fields(df: DataFrame, members: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Of each set and field the per-state extreme and the state of its peak; a field that is False takes the least."""
    return all_set_fields(df, members, fields)


def all_set_fields(df: DataFrame, members: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """``set_fields`` in one pass: all fields' extremes of each set and state by one aggregation, then their peaks from these."""
    inside = df.join(members, "part_id").select("set_id", "state_idx", *(QUANTITIES[f]().alias(f) for f in fields))
    states = inside.groupBy("set_id", "state_idx").agg(*((F.max if largest else F.min)(f).alias(f) for f, largest in fields.items()))
    long = states.select("set_id", "state_idx", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(largest).alias("largest")) for f, largest in fields.items()))))
    told = with_extremes(long, ["value"], F.col("state_idx").cast("long"))
    best = told.groupBy("set_id", "field", "largest").agg(F.max("value").alias("most"), F.min("value").alias("least"), at_largest("state_idx", "value").alias("at_most"), at_least("state_idx", "value").alias("at_least"))
    return best.select("set_id", "field", F.when(F.col("largest"), F.col("most")).otherwise(F.col("least")).alias("peak"), F.when(F.col("largest"), F.col("at_most")).otherwise(F.col("at_least")).alias("state_idx"))


def _direct(rows: DataFrame, fields: dict[str, Column], item: str) -> DataFrame:
    """Of each set, field and state the largest value and its item; peak marks the state of the largest (ties: the first)."""
    values = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()))
    each = rows.select("set_id", "state_idx", "time", item, F.inline(values)).where(F.col("value").isNotNull())
    told = with_extremes(each, ["value"], F.col(item).cast("long"))
    flat = told.groupBy("set_id", "field", "state_idx").agg(F.min("time").alias("time"), F.max("value").alias("value"), at_largest(item, "value").alias(item))
    first = F.row_number().over(Window.partitionBy("set_id", "field").orderBy(F.desc("value"), "state_idx")) == 1  # a series of states
    return flat.withColumn("peak", first)


def node_set_metrics(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Largest displacement, velocity and acceleration of the nodes of each set and state, with the node that has it; a motion that is not recorded gives no rows."""
    names = {"disp_mag": "displacement", "vel_mag": "velocity", "acc_mag": "acceleration"}
    return _direct(nodes.join(members, "node_id"), {k: QUANTITIES[q]() for k, q in names.items()}, "node_id")


def segment_set_metrics(states: DataFrame, parents: DataFrame) -> DataFrame:
    """Largest von Mises stress and plastic strain of the parent solids of each set of segments (set_id, element_id) and state."""
    names = {"von_mises": "von_mises", "eff_plastic_strain": "effective_plastic_strain"}
    return _direct(states.join(parents.select("set_id", "element_id").distinct(), "element_id"), {k: QUANTITIES[q]() for k, q in names.items()}, "element_id")


def single_pass(states: DataFrame, quantities: list[str], surfaces: DataFrame) -> DataFrame:
    """Statistics of parts and of surfaces from one scan: kind, target, state_idx, and max, min, avg and elements of each quantity.

    ``surfaces``: surface, element_id. Every row counts for its part and for each surface it
    is on; the rows are aggregated once, in tasks first.
    """
    on = surfaces.distinct().groupBy("element_id").agg(F.collect_list("surface").alias("__on"))  # surfaces of a job are few
    ready = states.select("part_id", "element_id", "state_idx", *(QUANTITIES[q]().alias(q) for q in quantities)).join(on, "element_id", "left")
    part = F.array(F.struct(F.lit("part").alias("kind"), F.col("part_id").cast("string").alias("target")))
    there = F.transform(F.coalesce("__on", F.array().cast("array<string>")), lambda name: F.struct(F.lit("surface").alias("kind"), name.alias("target")))
    each, told = _ready(ready.select("element_id", "state_idx", *quantities, F.inline(F.concat(part, there))), quantities)
    columns = []
    for q in quantities:
        columns += [F.max(q).alias(f"{q}_max"), F.min(q).alias(f"{q}_min"), F.avg(q).alias(f"{q}_avg"), at_largest("element_id", told[q]).alias(f"{q}_max_element")]
    return each.groupBy("kind", "target", "state_idx").agg(*columns)


#: Quantities of the pass over parts and faces, and those of a face.
SEVEN = ("von_mises", "principal_1", "principal_3", "effective_plastic_strain", "strain_principal_1", "strain_principal_3", "effective_strain")
OF_FACE = ("von_mises", "principal_1", "principal_3", "normal_stress", "shear_stress")


def parts_and_faces(states: DataFrame, faces: DataFrame, ties: int | None = None) -> DataFrame:
    """Both by one rule: kind (part or surface), target, state_idx, quantity, max, min, avg and the elements of the extremes.

    ``faces``: surface, element_id and the unit normal nx, ny, nz; an element may have several
    faces on a surface, and each counts. A part has the seven quantities of stress and strain,
    a surface von Mises, S1, S3 and the normal and shear stress on its faces; a quantity that
    is NULL in all rows gives none. Parts are many and have few rows a state, so the rows
    themselves are dealt by part and state, once, and quantities are made behind that; the rows
    of surfaces, which are few, are hashed in tasks first. None are sorted.
    """
    rows = states.select("part_id", "element_id", "state_idx", *STRESS, "eps", *STRAIN)
    values = lambda names, *columns: F.inline(F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(c).alias("value")) for q, c in zip(names, columns, strict=True))))

    def found(long: DataFrame, kind: str, target: str) -> DataFrame:
        told, by = _ready(long.where(F.col("value").isNotNull()), ["value"], ties)
        held = told.groupBy(target, "state_idx", "quantity").agg(F.max("value").alias("max"), F.min("value").alias("min"), F.avg("value").alias("avg"), at_largest("element_id", by["value"]).alias("max_element"), at_least("element_id", by["value"]).alias("min_element"))
        return held.select(F.lit(kind).alias("kind"), F.col(target).cast("string").alias("target"), "state_idx", "quantity", "max", "min", "avg", "max_element", "min_element")

    of_part = with_principals(with_principals(rows.repartition("part_id", "state_idx"), STRAIN, "e"), STRESS, "s")
    of_part = of_part.select("part_id", "element_id", "state_idx", F.sqrt(3 * F.col("sj2")).alias("vm"), "s1", "s3", "eps", "e1", "e3", F.sqrt(F.col("ej2") * 4 / 3).alias("evm"))
    of_part = of_part.select("part_id", "element_id", "state_idx", values(SEVEN, "vm", "s1", "s3", "eps", "e1", "e3", "evm"))
    of_face = rows.select("element_id", "state_idx", *STRESS).join(faces.select("element_id", "surface", "nx", "ny", "nz"), "element_id")
    of_face = with_face_stress(with_principals(of_face, STRESS, "s").withColumn("vm", F.sqrt(3 * F.col("sj2"))))
    of_face = of_face.select("surface", "element_id", "state_idx", values(OF_FACE, "vm", "s1", "s3", "normal", "shear"))
    return found(of_part, "part", "part_id").union(found(of_face, "surface", "surface"))


def progress(series: DataFrame, total_states: int) -> DataFrame:
    """How many of the states each part's history has, in percent."""
    return series.groupBy("part_id").agg(F.count_distinct("state_idx").alias("states")).withColumn("percent", F.col("states") * 100.0 / F.lit(total_states))


def beam_resultants(beams: DataFrame, names: tuple[str, ...] = ("axial", "shear_s", "shear_t", "moment_s", "moment_t", "torsion")) -> DataFrame:
    """Extremes of each resultant by part and state from (part_id, element_id, state_idx, words); values that aren't finite go.

    All resultants are aggregated side by side, and only the small result is turned to rows.
    """
    word = lambda i: F.get("words", F.lit(i))
    finite = {n: F.when(word(i).isNotNull() & ~F.isnan(word(i)) & (F.abs(word(i)) < float("inf")), word(i)) for i, n in enumerate(names)}
    rows = beams.select("part_id", "element_id", "state_idx", *(v.alias(n) for n, v in finite.items()))
    rows, told = _ready(rows, list(names))
    kinds = lambda n: (("max", F.max(n)), ("max_element", at_largest("element_id", told[n])), ("min", F.min(n)), ("min_element", at_least("element_id", told[n])))
    held = rows.groupBy("part_id", "state_idx").agg(*(v.alias(f"{n}_{k}") for n in names for k, v in kinds(n)))
    each = F.array(*(F.struct(F.lit(n).alias("component"), *(F.col(f"{n}_{k}").alias(k) for k in ("max", "max_element", "min", "min_element"))) for n in names))
    return held.select("part_id", "state_idx", F.inline(each)).where("max is not null")


def wide(series: DataFrame, quantity: str) -> DataFrame:
    """One row for each time, Part<id>_Max, _Min and _Avg columns."""
    named = series.withColumn("__p", F.concat(F.lit("Part"), F.col("part_id").cast("string")))
    return named.groupBy("time").pivot("__p").agg(F.first(f"{quantity}_max").alias("Max"), F.first(f"{quantity}_min").alias("Min"), F.first(f"{quantity}_avg").alias("Avg")).orderBy("time")


def motion(nodes: DataFrame, node_parts: DataFrame) -> DataFrame:
    """Mean and largest displacement of each part and state, with backward differences of the mean.

    ``nodes``: node_id, state_idx, time, x, y, z, x0, y0, z0. State 0 has no velocity, states
    0 and 1 no acceleration; a step that isn't positive gives 0.
    """
    d = F.sqrt(sum(((F.col(c) - F.col(c + "0")) * (F.col(c) - F.col(c + "0")) for c in "xyz"), F.lit(0.0)))
    finite = nodes.withColumn("__d", d).where(F.col("__d").isNotNull() & ~F.isnan("__d") & (F.col("__d") < float("inf")))
    means = [F.avg(F.col(c) - F.col(c + "0")).alias(f"mean_{c}") for c in "xyz"]
    stats = finite.join(node_parts, "node_id").groupBy("part_id", "state_idx").agg(F.min("time").alias("time"), *means, F.greatest(F.max("__d"), F.lit(0.0)).alias("max_displacement"))
    return differences(stats, ["mean_x", "mean_y", "mean_z"])


def differences(series: DataFrame, columns: list[str], key: str = "part_id") -> DataFrame:
    """velocity_ and acceleration_ of each column by backward differences over the states."""
    w = Window.partitionBy(key).orderBy("state_idx")
    step = F.col("time") - F.lag("time").over(w)
    out = series.withColumn("__dt", step)
    for order, prefix, source in ((1, "velocity_", ""), (2, "acceleration_", "velocity_")):
        rank = F.row_number().over(w)
        out = out.withColumns({prefix + c: F.when((rank > order) & (F.col("__dt") > 0), F.try_divide(F.col(source + c) - F.lag(source + c).over(w), F.col("__dt"))).otherwise(0.0) for c in columns})
    return out.drop("__dt")

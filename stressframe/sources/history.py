"""Binary histories: containers of typed records in folders, written by the solver beside its results.

A file has an eight-byte head (sizes of the fields of a record, byte order), then records:
length, command, and for data a type, a name and values. A folder record sets where the
following data belong: /branch/metadata for what stays, /branch/dNNNNNN for each time. A file
can only be walked from its start, so a task takes a file and passes over the values of
branches that are not asked for; a history of several files is their union.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import streams
from .binary import SPAN, store

#: Commands of records, and types by number.
FOLDER, DATA = 2, 3
TYPES = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8"}
#: Rows of a batch, and values after which one is handed on.
ROWS, VALUES = 1000, 1 << 20
#: Most bytes of a folder record.
FOLDER_BYTES = 1 << 16


#: Bytes of a read; a longer record is read whole.
CHUNK = 1 << 20


def tasks(files: int, size: int | None = None) -> int:
    """Tasks for so many files of so many bytes together: one each, but small files go together, as a task takes longer to begin than a small file to pass; where bytes are not known, beyond 200 files up to 32."""
    return max(1, min(files, max(200, ceil(files / 32)) if size is None else max(64, ceil(size / SPAN))))


def records(read, size: int, branches: Sequence[str] = ()) -> Iterator[tuple[str, str, np.ndarray]]:
    """(folder, name, values) of every data record, in order, by reads ``read(place, length)`` of a megabyte; whatever else a file holds is passed over, and so are records of other branches. A file that breaks off gives what is whole."""
    if size < 8:
        return
    at, width, _, command, kind, little = read(0, 8)[:6]
    order, ends, folder, wanted, body = "<" if little else ">", "little" if little else "big", "/", not branches, width + command
    held, start, number = b"", 0, int.from_bytes
    while at + body <= size:
        o = at - start
        if o + body > len(held):
            held, start, o = read(at, CHUNK), at, 0
        length, what = number(held[o : o + width], ends), number(held[o + width : o + body], ends)
        if length < body or at + length > size:
            return
        is_folder = what == FOLDER and length - body <= FOLDER_BYTES
        if is_folder or (what == DATA and wanted and length > body + kind):
            if o + length > len(held):
                held, start, o = read(at, max(length, CHUNK)), at, 0
            if is_folder:
                folder = posixpath.normpath(posixpath.join(folder, held[o + body : o + length].decode("latin-1").rstrip("\0")))
                wanted = not branches or "/".join(folder.strip("/").split("/")[:-1]) in branches
            else:
                name_at = o + body + kind + 1
                first = name_at + held[name_at - 1]
                form = TYPES.get(number(held[o + body : o + body + kind], ends))
                if form and first <= o + length:
                    count = (o + length - first) // int(form[1])
                    yield folder, held[name_at:first].decode("latin-1"), np.frombuffer(held, order + form, count, first) if count else np.empty(0)
        at += length


_READ = pa.schema([("file", pa.string()), ("branch", pa.string()), ("state", pa.string()), ("name", pa.string()), ("values", pa.list_(pa.float64()))])


def read(spark: SparkSession, path: str, branches: Sequence[str] = ()) -> DataFrame:
    """file, branch, state ('metadata' or dNNNNNN), name, values of every record (of ``branches``, if any) of the files of ``path``; text is an array of bytes."""

    def made(path: str, rows: list[tuple[str, str, str, np.ndarray]]) -> pa.RecordBatch:
        branch, state, name, values = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        arrays = [pa.array([path] * len(rows)), *(pa.array(c, pa.string()) for c in (branch, state, name)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))]
        return pa.RecordBatch.from_arrays(arrays, schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = store(path)
                with files.open_input_file(at) as file:
                    rows, held, last, place = [], 0, None, ("", "")
                    for folder, name, values in records(lambda place, length, file=file: file.read_at(length, place), file.size(), branches):
                        if folder != last:
                            parts = folder.strip("/").split("/")
                            last, place = folder, ("/".join(parts[:-1]), parts[-1])
                        rows.append((*place, name, values.astype(float)))
                        held += len(values)
                        if len(rows) == ROWS or held > VALUES:
                            yield made(path, rows)
                            rows, held = [], 0
                    if rows:
                        yield made(path, rows)

    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return listed.select("path").repartition(tasks(files, size), "path").mapInArrow(run, "file string, branch string, state string, name string, values array<double>")


def _states(rows: DataFrame, branch: str, names: Sequence[str]) -> DataFrame:
    """A row for each file and state: time, and an array for each name (NULL where it is not recorded)."""
    own = rows.where((F.col("branch") == branch) & F.col("state").rlike(r"^d\d+$") & F.col("name").isin("time", *names))
    held = lambda n: F.max(F.when(F.col("name") == n, F.col("values")))
    return own.groupBy("file", "state").agg(held("time")[0].alias("t"), *(held(n).alias(n) for n in names))


def _metadata(rows: DataFrame, branch: str, names: Sequence[str]) -> DataFrame:
    """One row: the metadata of a branch, from its first file."""
    own = rows.where((F.col("branch") == branch) & (F.col("state") == "metadata") & F.col("name").isin(*names))
    return own.agg(*(F.min_by(F.when(F.col("name") == n, F.col("values")), F.when(F.col("name") == n, F.col("file"))).alias(f"__{n}") for n in names))


def energies(rows: DataFrame) -> DataFrame:
    """t, ke, ie, hourglass, sliding, total of the branch glstat, a row for each time (of a time in two files the later file's)."""
    names = {"kinetic_energy": "ke", "internal_energy": "ie", "hourglass_energy": "hourglass", "sliding_interface_energy": "sliding", "total_energy": "total"}
    out = _states(rows, "glstat", list(names)).select("file", "t", *(F.col(n)[0].alias(a) for n, a in names.items()))
    latest = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("file")))
    return out.withColumn("__i", latest).where("__i = 1").drop("__i", "file")


def _each(states: DataFrame, meta: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A row for each place of the arrays of each state; ``meta`` is one row."""
    return states.crossJoin(F.broadcast(meta)).select("t", F.explode(F.sequence(F.lit(0), F.size("__ids") - 1)).alias("i"), "*").select("t", *(c.alias(n) for n, c in columns.items()))  # one row


def contact_forces(rows: DataFrame) -> DataFrame:
    """interface_id, side, t, fx, fy, fz of the branch rcforc; side 0 where the metadata has none."""
    at = lambda n: F.get(n, F.col("i"))
    side = F.coalesce(at("__side"), F.lit(0.0)).cast("int")
    columns = {"interface_id": at("__ids").cast("int"), "side": side, "fx": at("x_force"), "fy": at("y_force"), "fz": at("z_force")}
    return _each(_states(rows, "rcforc", ["x_force", "y_force", "z_force"]), _metadata(rows, "rcforc", ["ids", "side"]), columns)


def part_energies(rows: DataFrame) -> DataFrame:
    """part_id, t, ke, ie of the branch matsum."""
    at = lambda n: F.get(n, F.col("i"))
    columns = {"part_id": at("__ids").cast("int"), "ke": at("kinetic_energy"), "ie": at("internal_energy")}
    return _each(_states(rows, "matsum", ["kinetic_energy", "internal_energy"]), _metadata(rows, "matsum", ["ids"]), columns)


def _names(ids: str, legend: str) -> Column:
    """The name of place i: an equal share of the legend's bytes, without blanks."""
    share = F.floor(F.size(legend) / F.size(ids)).cast("int")
    letters = F.transform(F.slice(legend, F.col("i") * share + 1, share), lambda b: F.char(b.cast("int")))
    return F.when(share > 0, F.trim(F.regexp_replace(F.array_join(letters, ""), "\\x00", " ")))


def sliding_energies(rows: DataFrame) -> DataFrame:
    """interface_id, name, t, total_energy, friction_energy of the branch sleout; Interface_<id> where the legend has no name."""
    at = lambda n: F.get(n, F.col("i"))
    number = at("__ids").cast("int")
    columns = {"interface_id": number, "name": F.coalesce(_names("__ids", "__legend"), F.concat(F.lit("Interface_"), number.cast("string"))), "total_energy": at("total_energy"), "friction_energy": at("friction_energy")}
    return _each(_states(rows, "sleout", ["total_energy", "friction_energy"]), _metadata(rows, "sleout", ["ids", "legend"]), columns)


def _record(command: int, body: bytes, order: str) -> bytes:
    return (9 + len(body)).to_bytes(8, order) + bytes([command]) + body


def _data(name: str, values: np.ndarray, form: str, little: bool) -> bytes:
    kind = next(k for k, v in TYPES.items() if v == form)
    return _record(DATA, bytes([kind, len(name)]) + name.encode("latin-1") + np.asarray(values).astype(("<" if little else ">") + form).tobytes(), "little" if little else "big")


def _head(little: bool) -> bytes:
    return bytes([8, 8, 8, 1, 1, int(little), 0, 0])


def _batch(batch: pa.RecordBatch, current: str | None, place: str | None, little: bool) -> tuple[pa.RecordBatch, str | None, str | None]:
    """The bytes of a batch's records, a row for each file, and the file and folder that it ends in."""
    order, lists = "little" if little else "big", batch.column("values")
    flat, sizes = lists.flatten(), np.asarray(lists.fill_null([]).value_lengths())
    ends, heads, raw, out, parts = np.concatenate([[0], np.cumsum(sizes)]).tolist(), {}, {}, [], []
    for k, (file, folder, name, form) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "folder", "name", "form")), strict=True)):
        if file != current:
            if parts:
                out.append((current, b"".join(parts)))
            parts, current, place = [_head(little)], file, None
        if folder != place:
            place = folder
            parts.append(_record(FOLDER, place.encode("latin-1"), order))
        if form not in raw:  # all values in this form, of which a record takes its own
            with np.errstate(invalid="ignore"):
                raw[form] = flat.to_numpy(zero_copy_only=False).astype(("<" if little else ">") + form).tobytes()
        if flat.null_count and form[0] != "f" and flat[ends[k] : ends[k + 1]].null_count:
            raise ValueError(f"{file}: a whole number of {name} is missing")
        count, wide = ends[k + 1] - ends[k], int(form[1])
        key = (name, form, count)
        if key not in heads:
            heads[key] = _data(name, np.zeros(count), form, little)[: -count * wide or None]
        parts.append(heads[key])
        parts.append(raw[form][ends[k] * wide : ends[k + 1] * wide])
    if parts:
        out.append((current, b"".join(parts)))
    names, data = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["file", "data"]), current, place


def write(rows: DataFrame, folder: str, little: bool = True, files: int | None = None) -> None:
    """Write files from rows: file, at (the order within the file), folder, name, form (f8, i4, ...), values.

    A task sorts and streams the files it has; a folder is written where it changes. ``files``
    is about their number, which a pass over the rows finds where it is not told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = None, None
        for batch in batches:
            made, current, place = _batch(batch, current, place, little)
            yield made

    count = files if files is not None else rows.select(F.approx_count_distinct("file")).first()[0]
    dealt = rows.repartition(tasks(ceil(count)), "file").sortWithinPartitions("file", "at")
    streams.write(dealt.select("file", "folder", "name", "form", "values").mapInArrow(run, streams.ROWS), folder)


def pack(folders: Sequence[tuple[str, Sequence[tuple[str, np.ndarray]]]], little: bool = True) -> bytes:
    """Bytes of a small file of (folder, (name, values) ...)."""
    out = [_head(little)]
    for folder, data in folders:
        out.append(_record(FOLDER, folder.encode("latin-1"), "little" if little else "big"))
        for name, values in data:
            values = np.asarray(values)
            out.append(_data(name, values, f"{values.dtype.kind}{values.dtype.itemsize}", little))
    return b"".join(out)

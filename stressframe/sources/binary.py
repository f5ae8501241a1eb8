"""Binary result families: a base file with the mesh, and files of states beside it.

Words have four or eight bytes in either order; the header tells all strides, so where any
value stands is arithmetic. The data source ``result_family`` reads by that: a task takes a
range of states of a file (or of the elements of one state, where that is large) and reads
the bytes of the class and fields asked for, no others. Filters on ``part`` and ``place``
drop ranges before they are tasks. The writer of the same source gets rows that know their
place, sorted; each task streams whole files, which take their names when the job commits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Places of the header's whole numbers.
HEADER = {"ndim": 15, "numnp": 16, "nglbv": 18, "it": 19, "iu": 20, "iv": 21, "ia": 22, "nel8": 23, "nv3d": 27, "nel2": 28, "nv1d": 30, "nel4": 31, "nv2d": 33, "maxint": 36, "narbs": 39, "nelt": 40, "nv3dt": 42, "extra": 57}
VERSION_WORD, VERSIONS, WORDS, END = 14, (900.0, 2000.0), 64, -999999.0
#: Classes in the order of the mesh and in that of a state, and of the ids; words of a connectivity, corners, counters, words of a state.
CLASSES = ("SOLID", "THICK_SHELL", "BEAM", "SHELL")
CARD = {"SOLID": 9, "THICK_SHELL": 9, "BEAM": 6, "SHELL": 5}
CORNERS = {"SOLID": 8, "THICK_SHELL": 8, "BEAM": 2, "SHELL": 4}
COUNT = {"SOLID": "nel8", "THICK_SHELL": "nelt", "BEAM": "nel2", "SHELL": "nel4"}
WIDTH = {"SOLID": "nv3d", "THICK_SHELL": "nv3dt", "BEAM": "nv1d", "SHELL": "nv2d"}
#: Fields of a node by the units digit of the temperature code.
TEMPERATURES = {1: 1, 2: 3, 3: 3}
#: Bytes of a range, and rows of a batch.
SPAN, ROWS = 32 << 20, 1 << 15
#: Ranges that a smaller span may make; beyond them ranges grow, up to SPAN, as a task for each few thousand bytes would take longer than all reading.
RANGES = 256
#: Most words between two rows that are written at once with them.
GAP = 1 << 10


@dataclass(frozen=True)
class Layout:
    """Word type and counters of a family, and where everything stands, in words."""

    order: str
    size: int
    title: str
    n: dict

    @property
    def real(self) -> str:
        return f"{self.order}f{self.size}"

    @property
    def whole(self) -> str:
        return f"{self.order}i{self.size}"

    def count(self, etype: str) -> int:
        """Elements of a class; the counter of solids is negative where they have ten nodes."""
        return abs(self.n[COUNT[etype]])

    @property
    def nodes_at(self) -> int:
        return WORDS + self.n["extra"]

    def cards_at(self, etype: str) -> int:
        """Where the connectivities of a class begin; the further nodes of ten-node solids stand behind the solids."""
        at = self.nodes_at + 3 * self.n["numnp"]
        for kind in CLASSES[: CLASSES.index(etype)]:
            at += CARD[kind] * self.count(kind) + (2 * self.count(kind) if kind == "SOLID" and self.n["nel8"] < 0 else 0)
        return at

    @property
    def ids_at(self) -> int:
        return self.cards_at("SHELL") + CARD["SHELL"] * self.count("SHELL")

    @property
    def mesh_words(self) -> int:
        return self.ids_at + self.n["narbs"]

    def nodal(self) -> tuple[int, dict[str, tuple[int, int]]]:
        """Where the nodal words of a state end, and of each field its start and words for a node."""
        n, at, out = self.n, 1 + self.n["nglbv"], {}
        fields = (("temperature", TEMPERATURES.get(n["it"] % 10, 0)), ("place", 3 * n["iu"]), ("velocity", 3 * n["iv"]), ("acceleration", 3 * n["ia"]), ("mass", int(n["it"] >= 10)))
        for name, words in fields:
            if words:
                out[name] = (at, words)
            at += words * n["numnp"]
        return at, out

    def values_at(self, etype: str) -> tuple[int, int]:
        """Where the words of a class begin in a state, and the words of an element."""
        at = self.nodal()[0]
        for kind in CLASSES[: CLASSES.index(etype)]:
            at += self.count(kind) * self.n[WIDTH[kind]]
        return at, self.n[WIDTH[etype]]

    @property
    def deletion_words(self) -> int:
        """A word for each node, or for each element, by the sign and size of the counter of integration points."""
        if self.n["maxint"] >= 0:
            return 0
        return sum(map(self.count, CLASSES)) if self.n["maxint"] < -10000 else self.n["numnp"]

    @property
    def state_words(self) -> int:
        at, width = self.values_at("SHELL")
        return at + self.count("SHELL") * width + self.deletion_words


def detect(raw: bytes) -> Layout:
    """Layout by the version word: the first of the four word types with a plausible one."""
    for size in (4, 8):
        for order in ("<", ">"):
            if len(raw) >= WORDS * size:
                version = np.frombuffer(raw, f"{order}f{size}", 1, VERSION_WORD * size)[0]
                if VERSIONS[0] <= version <= VERSIONS[1]:
                    ints = np.frombuffer(raw, f"{order}i{size}", WORDS)
                    title = raw[: 10 * size].decode("ascii", "ignore").strip("\0 ")
                    return Layout(order, size, title, {k: int(ints[i]) for k, i in HEADER.items()})
    raise ValueError("no result family: the version word is not plausible in any word type")


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, as the driver and tasks reach it."""
    if "://" not in path and not path.startswith("file:"):
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(path)


def _head(base: str) -> Layout:
    files, path = store(base)
    with files.open_input_file(path) as file:
        return detect(file.read_at(min(WORDS * 8, file.size()), 0))


def _files(base: str) -> list[tuple[str, int, int]]:
    """(path, part, bytes) of the files up to the first gap."""
    files, path = store(base)
    folder, name = path.rstrip("/").rsplit("/", 1)
    found = {}
    for info in files.get_file_info(stores.FileSelector(folder)):
        rest = re.fullmatch(re.escape(name) + "([0-9]*)", info.base_name)
        if rest and info.type == stores.FileType.File:
            found[int(rest[1] or 0)] = (info.path, info.size)
    out = []
    while len(out) in found:
        out.append((found[len(out)][0], len(out), found[len(out)][1]))
    return out


def family(spark: SparkSession, base: str) -> DataFrame:
    """path, part (0 for the base, then 1, 2, ...) and length of the files up to the first gap."""
    return spark.createDataFrame(_files(base), "path string, part int, length long")


def layout(spark: SparkSession, base: str) -> Layout:
    """Header of the base file, of which no more is read."""
    return _head(base)


@dataclass
class Range(InputPartition):
    """States [first, last) of a file and things [low, high) of each; of a mesh, things alone."""

    path: str
    part: int
    start: int
    first: int
    last: int
    low: int
    high: int


#: Columns of what can be asked for.
SCHEMAS = {
    "times": "part int, place int, time double",
    "globals": "part int, place int, time double, i int, value double",
    "node_states": "part int, place int, time double, node_idx int, x double, y double, z double, vx double, vy double, vz double, ax double, ay double, az double",
    "element_states": "part int, place int, time double, elem_idx int, words array<double>",
    "nodes": "node_idx int, node_id int, x double, y double, z double",
    "elements": "etype string, elem_idx int, elem_id int, part_id int, material_id int, node_ids array<int>",
}
_KINDS = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
NODAL = {"place": ("x", "y", "z"), "velocity": ("vx", "vy", "vz"), "acceleration": ("ax", "ay", "az")}


class FamilyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.content = options["path"], options.get("content", "times")
        self.at, self.etype, self.span = _head(self.base), options.get("etype", "SOLID"), int(options.get("span", SPAN))
        self.fields = [f for f in options.get("fields", ",".join(NODAL)).split(",") if f]
        self.words = [int(k) for k in options.get("words", "").split(",") if k]
        self.kept: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of part and place drop ranges; rows of a range that is read in part are left to Spark."""
        tests = {EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w}
        for f in filters:
            if type(f) in tests and f.attribute in (("part",), ("place",)) and self.content not in ("nodes", "elements"):
                self.kept.append((f.attribute[0], type(f).__name__, f.value))
            yield f

    def _wanted(self, column: str, value: int) -> bool:
        known = {"EqualTo": lambda v, w: v == w, "GreaterThan": lambda v, w: v > w, "GreaterThanOrEqual": lambda v, w: v >= w, "LessThan": lambda v, w: v < w, "LessThanOrEqual": lambda v, w: v <= w, "In": lambda v, w: v in w}
        return all(known[how](value, w) for c, how, w in self.kept if c == column)

    def _states(self, path: str, part: int, size: int) -> tuple[int, int]:
        """Where the states of a file begin (in words), and how many there are before its end mark.

        Marks stand where a state would begin; the last boundaries are looked at first, and a
        file that ends with a state needs none.
        """
        at, words = self.at, size // self.at.size
        with store(self.base)[0].open_input_file(path) as file:
            word = lambda k: np.frombuffer(file.read_at(at.size, k * at.size), at.real)[0]
            start = at.mesh_words if part == 0 else 0
            while start < words and word(start) == END:
                start += 1
            n, rest = divmod(max(words - start, 0), at.state_words)
            for k in range(n if rest else n - 1, -1, -1) if words > start else ():
                if word(start + k * at.state_words) == END:
                    return start, k
                if not rest and k == n - 1:
                    break  # no padding, no mark
        return start, n

    def _things(self) -> tuple[int, int]:
        """How many things a state has, and the words that are read for each."""
        at = self.at
        if self.content == "element_states":
            return at.count(self.etype), at.values_at(self.etype)[1]
        if self.content == "node_states":
            return at.n["numnp"], 3 * max(1, len(self.fields))
        return 1, 1 + at.n["nglbv"] if self.content == "globals" else 1

    def _span(self, size: int) -> int:
        """Bytes of a range, where so many are read in all."""
        return max(self.span, min(SPAN, size // RANGES))

    def partitions(self) -> Sequence[Range]:
        at, out = self.at, []
        if self.content in ("nodes", "elements"):
            kinds = [("NODE", at.n["numnp"], 3)] if self.content == "nodes" else [(k, at.count(k), CARD[k]) for k in CLASSES]
            span = self._span(sum(count * words * at.size for _, count, words in kinds))
            for kind, count, words in kinds:
                step = max(1, span // (words * at.size))
                out += [Range(kind, 0, 0, 0, 0, low, min(count, low + step)) for low in range(0, count, step)]
            return out or [Range("NODE" if self.content == "nodes" else "SOLID", 0, 0, 0, 0, 0, 0)]
        things, words = self._things()
        each = max(1, things * words * at.size)
        asked = []
        for path, part, size in _files(self.base):
            if self._wanted("part", part):
                start, n = self._states(path, part, size)
                asked.append((path, part, start, [k for k in range(n) if self._wanted("place", k)]))
        span = self._span(sum(len(places) for *_, places in asked) * each)
        states, step = max(1, span // each), max(1, span // (words * at.size)) if words else things
        if self.content == "times":
            states = 4096  # reads of a word each
        for path, part, start, places in asked:
            runs = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1) if places else []
            for run in runs:
                for first in range(int(run[0]), int(run[-1]) + 1, states):
                    last = min(int(run[-1]) + 1, first + states)
                    out += [Range(path, part, start, first, last, low, min(things, low + step)) for low in range(0, max(things, 1), step)]
        return out or [Range("", 0, 0, 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, base = store(self.base)
        make = getattr(self, f"_{self.content}")
        with files.open_input_file(base if self.content in ("nodes", "elements") else partition.path or base) as file:
            for columns in make(file, partition):
                fields = [c.split() for c in SCHEMAS[self.content].split(", ")]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    def _real(self, file, word: int, count: int) -> np.ndarray:
        return np.frombuffer(file.read_at(count * self.at.size, word * self.at.size), self.at.real).astype(float)

    def _whole(self, file, word: int, count: int) -> np.ndarray:
        return np.frombuffer(file.read_at(count * self.at.size, word * self.at.size), self.at.whole).astype(np.int32)

    def _each_state(self, file, r: Range) -> Iterator[tuple[int, int, float]]:
        """place, first word and time of the states of a range."""
        for place in range(r.first, r.last):
            start = r.start + place * self.at.state_words
            yield place, start, self._real(file, start, 1)[0]

    def _times(self, file, r: Range):
        rows = [(place, time) for place, _, time in self._each_state(file, r)]
        yield np.full(len(rows), r.part), [p for p, _ in rows], [t for _, t in rows]

    def _globals(self, file, r: Range):
        n = self.at.n["nglbv"]
        for place, start, time in self._each_state(file, r):
            yield np.full(n, r.part), np.full(n, place), np.full(n, time), np.arange(n), self._real(file, start + 1, n)

    def _blocks(self, file, r: Range):
        for place, start, time in self._each_state(file, r):
            for low in range(r.low, r.high, ROWS):
                high = min(r.high, low + ROWS)
                yield start, low, high, (np.full(high - low, r.part), np.full(high - low, place), np.full(high - low, time), np.arange(low, high))

    def _node_states(self, file, r: Range):
        held = self.at.nodal()[1]
        for start, low, high, keys in self._blocks(file, r):
            columns = []
            for name, letters in NODAL.items():
                if name in held and name in self.fields:
                    block = self._real(file, start + held[name][0] + 3 * low, 3 * (high - low)).reshape(-1, 3)
                    columns += [block[:, k] for k in range(3)]
                else:
                    columns += [pa.nulls(high - low, pa.float64()) for _ in letters]
            yield (*keys, *columns)

    def _element_states(self, file, r: Range):
        begin, width = self.at.values_at(self.etype)
        for start, low, high, keys in self._blocks(file, r):
            block = self._real(file, start + begin + width * low, width * (high - low)).reshape(high - low, width)
            block = block[:, self.words] if self.words else block
            ends = np.arange(high - low + 1, dtype=np.int32) * block.shape[1]
            yield (*keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(block.ravel())))

    def _ids(self, file, kind: str, low: int, high: int) -> np.ndarray:
        """User ids of things [low, high) of a class; places from 1 where the block is absent or too short."""
        at, place = self.at, 10
        counts = [("NODE", at.n["numnp"]), *((k, at.count(k)) for k in CLASSES)]
        if at.n["narbs"] >= 10:
            place = 16 if self._whole(file, at.ids_at, 1)[0] < 0 else 10
            for k, c in counts:
                if k == kind:
                    if place + c <= at.n["narbs"]:
                        return self._whole(file, at.ids_at + place + low, high - low)
                    break
                place += c
        return np.arange(low + 1, high + 1, dtype=np.int32)

    def _nodes(self, file, r: Range):
        for low in range(r.low, r.high, ROWS):
            high = min(r.high, low + ROWS)
            block = self._real(file, self.at.nodes_at + 3 * low, 3 * (high - low)).reshape(-1, 3)
            yield np.arange(low, high), self._ids(file, "NODE", low, high), *(block[:, k] for k in range(3))

    def _elements(self, file, r: Range):
        kind, words = r.path, CARD[r.path]
        for low in range(r.low, r.high, ROWS):
            high = min(r.high, low + ROWS)
            block = self._whole(file, self.at.cards_at(kind) + words * low, words * (high - low)).reshape(-1, words)
            corners, ends = block[:, : CORNERS[kind]] - 1, np.arange(high - low + 1, dtype=np.int32) * CORNERS[kind]
            yield [kind] * (high - low), np.arange(low, high), self._ids(file, kind, low, high), block[:, -1], block[:, -1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(corners).ravel()))


#: What the writer takes: a file, the word at which a row begins, its words, and whether these are whole numbers.
PLACED = "file int, at long, words array<double>, whole boolean"


@dataclass
class Written(WriterCommitMessage):
    """Temporary names of the files that a task has written, by number."""

    names: dict[int, str]


class FamilyWriter(DataSourceArrowWriter):
    """Streams rows in order of file and place; what no row fills is zero. A file's length in words and its end mark come from the options."""

    def __init__(self, options: dict):
        self.base, self.order, self.size = options["path"], options["order"], int(options["size"])
        self.head, self.length = bytes.fromhex(options["head"]), {int(k): int(v) for k, v in (pair.split(":") for pair in options["lengths"].split(","))}
        self.temporary = f"_temporary-{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = store(self.base)
        folder = f"{path.rsplit('/', 1)[0]}/{self.temporary}"
        files.create_dir(folder, recursive=True)
        out, at, names, current = None, 0, {}, None
        for batch in iterator:
            file, start = batch.column("file").to_numpy(), batch.column("at").to_numpy()
            words, whole = batch.column("words"), batch.column("whole").to_numpy(zero_copy_only=False)
            sizes = np.asarray(words.value_lengths())
            values, ends = np.asarray(words.flatten()), np.concatenate([[0], np.cumsum(sizes)])
            gap = start[1:] - (start[:-1] + sizes[:-1])
            breaks = np.flatnonzero((file[1:] != file[:-1]) | (whole[1:] != whole[:-1]) | (gap < 0) | (gap > GAP)) + 1
            place = np.repeat(start - ends[:-1], sizes) + np.arange(len(values))  # the word of each value
            for a, b in zip([0, *breaks], [*breaks, len(file)], strict=True):
                if a == b:
                    continue
                if file[a] != current:
                    self._finish(out, at, current)
                    current, at = int(file[a]), 0
                    names[current] = uuid.uuid4().hex
                    out = files.open_output_stream(f"{folder}/{names[current]}", compression=None)
                    if current == 0:
                        out.write(self.head)
                        at = len(self.head) // self.size
                if start[a] < at:
                    raise ValueError(f"file {current}: two rows at word {start[a]}")
                self._zeros(out, start[a] - at)
                run = np.zeros(int(start[b - 1] + sizes[b - 1] - start[a]))
                run[place[ends[a] : ends[b]] - start[a]] = values[ends[a] : ends[b]]
                out.write(np.asarray(run, f"{self.order}{'i' if whole[a] else 'f'}{self.size}").tobytes())
                at = int(start[a]) + len(run)
        self._finish(out, at, current)
        return Written(names)

    def _zeros(self, out, words: int) -> None:
        while words > 0:
            out.write(bytes(min(words, 1 << 20) * self.size))
            words -= 1 << 20

    def _finish(self, out, at: int, current: int | None) -> None:
        if out is None:
            return
        if at > self.length[current]:
            raise ValueError(f"file {current}: words beyond its end")
        self._zeros(out, self.length[current] - at)
        if current:
            out.write(np.array([END], f"{self.order}f{self.size}").tobytes())
        out.close()

    def commit(self, messages: list[Written | None]) -> None:
        files, path = store(self.base)
        folder = f"{path.rsplit('/', 1)[0]}/{self.temporary}"
        for message in messages:
            for k, name in (message.names if message else {}).items():
                files.move(f"{folder}/{name}", path if k == 0 else f"{path}{k:02d}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, path = store(self.base)
        folder = f"{path.rsplit('/', 1)[0]}/{self.temporary}"
        if files.get_file_info(folder).type == stores.FileType.Directory:
            files.delete_dir(folder)


class ResultFamily(DataSource):
    """``spark.read.format("result_family")`` with the options path, content, etype, fields, words, span."""

    @classmethod
    def name(cls) -> str:
        return "result_family"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "times")]

    def reader(self, schema) -> FamilyReader:
        return FamilyReader(self.options)

    def writer(self, schema, overwrite: bool) -> FamilyWriter:
        return FamilyWriter(self.options)


def _load(spark: SparkSession, base: str, content: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultFamily)
    return spark.read.format("result_family").options(path=base, content=content, **{k: str(v) for k, v in options.items()}).load()


def nodes(spark: SparkSession, base: str, span: int = SPAN) -> DataFrame:
    """node_idx (from 0), node_id, x, y, z."""
    return _load(spark, base, "nodes", span=span)


def elements(spark: SparkSession, base: str, span: int = SPAN) -> DataFrame:
    """etype, elem_idx, elem_id, part_id, material_id, node_ids (indexes from 0)."""
    return _load(spark, base, "elements", span=span)


def element_states(spark: SparkSession, base: str, etype: str, words: Sequence[int] = (), span: int = SPAN) -> DataFrame:
    """part, place, time, elem_idx, words of each element of a class; of each only the ``words`` asked for, if any."""
    if etype not in CLASSES:
        raise KeyError(etype)
    return _load(spark, base, "element_states", etype=etype, words=",".join(map(str, words)), span=span)


def times(spark: SparkSession, base: str) -> DataFrame:
    """part, place and time of every state; no other words are read."""
    return _load(spark, base, "times")


def node_states(spark: SparkSession, base: str, fields: Sequence[str] = tuple(NODAL), span: int = SPAN) -> DataFrame:
    """part, state (its place in the file), time, node_idx, x, y, z, vx, vy, vz, ax, ay, az of every node and state; NULL for what the family does not record or ``fields`` (place, velocity, acceleration) does not name."""
    return _load(spark, base, "node_states", fields=",".join(fields), span=span).withColumnRenamed("place", "state")


def global_states(spark: SparkSession, base: str) -> DataFrame:
    """part, state, time, i and value of the global words of every state."""
    return _load(spark, base, "globals").withColumnRenamed("place", "state")


def header(at: Layout, version: float = 960.0) -> bytes:
    """Bytes of the header of a base file."""
    head = bytearray((WORDS + at.n["extra"]) * at.size)
    text = at.title.encode("ascii", "replace")[: 10 * at.size]
    head[: len(text)] = text
    head[VERSION_WORD * at.size : (VERSION_WORD + 1) * at.size] = np.array([version], at.real).tobytes()
    for k, i in HEADER.items():
        head[i * at.size : (i + 1) * at.size] = np.array([at.n[k]], at.whole).tobytes()
    return bytes(head)


def _counted(nodes: DataFrame, elements: DataFrame) -> dict:
    """Counters of a mesh: the largest index of each class and one more."""
    found = {r[0]: r[1] + 1 for r in elements.groupBy("etype").agg(F.max("elem_idx")).collect()}  # four rows
    return {"numnp": nodes.agg(F.coalesce(F.max("node_idx") + 1, F.lit(0))).first()[0], **{COUNT[k]: found.get(k, 0) for k in CLASSES}}


def write_family(base: str, title: str, nodes: DataFrame, elements: DataFrame, states: DataFrame, node_states: DataFrame | None = None, element_states: dict[str, DataFrame] | None = None, order: str = "<", size: int = 4, states_per_file: int = 100, with_ids: bool = True, widths: dict[str, int] | None = None) -> Layout:
    """Write a family from tables, and return its layout.

    nodes: node_idx, node_id, x, y, z. elements: etype, elem_idx, elem_id, material_id, node_ids.
    states: state_idx (0, 1, ...), time, globals (an array of one length). node_states:
    state_idx, node_idx and the columns of place, velocity and acceleration that it has.
    element_states: state_idx, elem_idx, words (of one length, counted by a pass over the rows
    where ``widths`` does not tell it) by class. What no row names is zero; a node, element
    or state named twice is an error. Rows are sorted by their place, a task for each file;
    nothing but counters reaches the driver.
    """
    spark, element_states = nodes.sparkSession, element_states or {}
    n = dict.fromkeys(HEADER, 0) | {"ndim": 4} | _counted(nodes, elements)
    last, n["nglbv"] = states.agg(F.max("state_idx"), F.coalesce(F.max(F.size("globals")), F.lit(0))).first()
    for kind, rows in element_states.items():
        n[WIDTH[kind]] = widths[kind] if widths and kind in widths else rows.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    for flag, name in (("iu", "place"), ("iv", "velocity"), ("ia", "acceleration")):
        n[flag] = int(node_states is not None and set(NODAL[name]) <= set(node_states.columns))
    total = n["numnp"] + sum(n[COUNT[k]] for k in CLASSES)
    n["narbs"] = 10 + total if with_ids else 0
    at = Layout(order, size, title, n)
    count = last + 1 if last is not None else 0
    held = [min(states_per_file, count - k) for k in range(0, count, states_per_file)]

    def row(file, word, words, whole=False) -> list[Column]:
        return [file.cast("int").alias("file"), word.cast("long").alias("at"), words.cast("array<double>").alias("words"), F.lit(whole).alias("whole")]

    zero = F.lit(0)
    placed = [nodes.select(row(zero, at.nodes_at + 3 * F.col("node_idx").cast("long"), F.array("x", "y", "z")))]
    ids_at = at.ids_at + 10
    if with_ids:
        counts = [n["numnp"], *(n[COUNT[k]] for k in CLASSES)]
        placed.append(spark.range(1).select(row(zero, F.lit(at.ids_at), F.array(*map(F.lit, [counts[0], 0, 0, 0, 0, *counts])), True)))  # ten counters
        placed.append(nodes.select(row(zero, ids_at + F.col("node_idx").cast("long"), F.array("node_id"), True)))
        ids_at += n["numnp"]
    for kind in CLASSES:
        own, index = elements.where(F.col("etype") == kind), F.col("elem_idx").cast("long")
        blank = F.array(*[F.lit(0)] * (CARD[kind] - CORNERS[kind] - 1)) if CARD[kind] - CORNERS[kind] > 1 else F.array().cast("array<int>")
        card = F.concat(F.transform("node_ids", lambda i: i + 1), blank, F.array("material_id"))
        placed.append(own.select(row(zero, at.cards_at(kind) + CARD[kind] * index, card, True)))
        if with_ids:
            placed.append(own.select(row(zero, ids_at + index, F.array("elem_id"), True)))
            ids_at += n[COUNT[kind]]
    state = F.col("state_idx").cast("long")
    file, begin = F.floor(state / states_per_file) + 1, (state % states_per_file) * at.state_words
    placed.append(states.select(row(file, begin, F.concat(F.array("time"), F.coalesce("globals", F.array().cast("array<double>"))))))
    for name, (start, words) in at.nodal()[1].items():
        if name in NODAL:
            placed.append(node_states.select(row(file, begin + start + words * F.col("node_idx").cast("long"), F.array(*NODAL[name]))))
    for kind, rows in element_states.items():
        start, width = at.values_at(kind)
        words = F.when(F.size("words") <= width, F.col("words")).otherwise(F.raise_error(F.lit(f"{kind}: more than {width} words")))
        placed.append(rows.select(row(file, begin + start + width * F.col("elem_idx").cast("long"), words)))
    lengths = {0: at.mesh_words, **{k: c * at.state_words for k, c in enumerate(held, 1)}}
    rows = spark.createDataFrame([(k, end, [], False) for k, end in lengths.items()], PLACED)  # so that a file of no rows is there too
    for more in placed:
        rows = rows.union(more)
    spark.dataSource.register(ResultFamily)
    options = {"path": base, "order": order, "size": str(size), "head": header(at).hex(), "lengths": ",".join(f"{k}:{v}" for k, v in lengths.items()), "job": uuid.uuid4().hex}
    dealt = rows.repartitionById(len(lengths), F.col("file")).sortWithinPartitions("file", "at")
    dealt.write.format("result_family").options(**options).mode("append").save()
    return replace(at)


def write_bytes(base: str, mesh: bytes, files: Sequence[bytes]) -> None:
    """Write small files as they are: a base file and files of states beside it."""
    system, path = store(base)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    for name, raw in [(path, mesh), *((f"{path}{k:02d}", x) for k, x in enumerate(files, 1))]:
        with system.open_output_stream(name, compression=None) as out:
            out.write(raw)


def pack_ids(ids: dict[str, np.ndarray]) -> np.ndarray:
    """The block of user ids: ten counters, then the ids of nodes, solids, thick shells, beams and shells."""
    parts = [np.asarray(ids.get(k, ()), np.int64) for k in ("node", *CLASSES)]
    head = np.zeros(10, np.int64)
    head[0], head[5:10] = len(parts[0]), [len(p) for p in parts]
    return np.concatenate([head, *parts])


def pack_mesh(title: str, counters: dict, coordinates: np.ndarray, cells: dict[str, np.ndarray], order: str = "<", size: int = 4, version: float = 960.0, ids: np.ndarray | None = None) -> bytes:
    """Bytes of a small base file: header, coordinates, connectivities (indexes from 1, material last) and the block of user ids, if any."""
    n = dict.fromkeys(HEADER, 0) | {"ndim": 4, "numnp": len(coordinates)} | {COUNT[c]: len(cells.get(c, ())) for c in CLASSES} | counters
    at = Layout(order, size, title, n | ({"narbs": len(ids)} if ids is not None else {}))
    parts = [header(at, version), np.asarray(coordinates, at.real).tobytes()]
    for c in CLASSES:
        parts.append(np.asarray(cells.get(c, ()), at.whole).tobytes())
        if c == "SOLID" and n["nel8"] < 0:
            parts.append(bytes(2 * abs(n["nel8"]) * size))
    return b"".join(parts if ids is None else [*parts, np.asarray(ids, at.whole).tobytes()])


def pack_states(rows: list[np.ndarray], order: str = "<", size: int = 4) -> bytes:
    """Bytes of a small file of states, with its end mark."""
    return b"".join([*(np.asarray(r, f"{order}f{size}").tobytes() for r in rows), np.array([END], f"{order}f{size}").tobytes()])

"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first ``length`` bytes, most significant digit first;
suffixes that stay together through all of them start the same passage, and nothing beyond
is ever compared. The passes are over digits of very uneven width:

1. The first digit of a suffix is an anchor: the least hash of any ``length // 4`` bytes
   within the first ``length``, which depends on these bytes alone. A text has two or
   three anchors in ``length`` bytes, so only anchors are dealt out, not suffixes; those
   found once are done, as every suffix under them is.
2. Of the anchors left, the next digits are the bytes to the right and to the left of the
   anchor, up to ``length`` in all. All suffixes of one anchor are ordered together, a digit
   at a time by running hashes of 64 bits; groups of two or more are repeated windows.

Groups too large for one task are not gathered: their suffixes get another digit first. Those
with more bytes to the left of the anchor part by the bytes on that side, the others by those
on the right, and so on by halves. Places alike through a whole range of windows are repeated
there and go on as one, so a passage in very many texts costs a row for each of its places
and digit, never a row for each window. Equal texts are sorted once and are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, split_by

LENGTH = 200
#: Parameter: groups of more places than this get another digit before they are gathered.
OFTEN = 20_000

_RNG = np.random.default_rng(13)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _POWERS


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of every ``width`` neighbours, from running ones of blocks."""
    op, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    blocks = np.pad(x, (0, -len(x) % width), constant_values=fill).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def digit(length: int) -> int:
    """Bytes of an anchor."""
    return max(1, length // 4)


def anchors(raw: np.ndarray, length: int = LENGTH, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a text's bytes: strings of a quarter of the length whose hash is least in some window of ``length`` bytes."""
    k = digit(length)
    found, step = [], max(piece, 2 * length)
    for start in range(0, max(1, len(raw) - length + 1), step):
        part = raw[start : start + step + length - 1]
        if len(part) < length:
            continue
        powers, back = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * powers[: len(part)])])
        h = _stir((sums[k:] - sums[:-k]) * back[: len(part) - k + 1])
        least = _sliding(h, length - k + 1, True)
        around = np.pad(least, (length - k, length - k), constant_values=0)
        at = np.flatnonzero(_sliding(around, length - k + 1, False) == h)
        found.append((h[at], at + start))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return h, at


def scanned(documents: DataFrame, length: int) -> DataFrame:
    """digest, n_bytes, sha256, anchors (hashes, places) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                raws = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                found = [anchors(np.frombuffer(r, np.uint8), length) for r in raws]
                ends = pa.array(np.cumsum([0] + [len(h) for h, _ in found]), pa.int32())
                hashes, places = (np.concatenate(x) if x else np.zeros(0) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.md5(r).hexdigest() for r in raws]), pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.ListArray.from_arrays(ends, pa.array(hashes.astype(np.uint64).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int64)))],
                    ["doc_id", "digest", "n_bytes", "sha256", "hashes", "places"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest string, n_bytes long, sha256 string, hashes array<long>, places array<long>")


def flank_hashes(parts: list[bytes], width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of 0 to ``width`` bytes away from the anchor, and how many bytes there are."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join((p[::-1] if flip else p).ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    out = np.zeros((len(parts), width + 1), np.uint64)
    np.cumsum(_LETTERS[raw] * _powers(width + 1)[0][:width], axis=1, out=out[:, 1:])
    return _stir(out), n


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an anchor the largest and least number of bytes to its left with which a window is repeated; -1 for none.

    ``group`` tells groups apart; only windows with ``low`` to ``high`` bytes to the left count.
    """
    width = length - digit(length)
    a, have_a = flank_hashes(left, width, True)
    b, have_b = flank_hashes(right, width, False)
    most, least = np.full(len(group), -1, np.int64), np.full(len(group), -1, np.int64)
    for s in range(width + 1):
        own = np.flatnonzero((have_a >= s) & (have_b >= width - s) & (low <= s) & (s <= high))
        if len(own) > 1:
            key = _stir(a[own, s] * np.uint64(3) + b[own, width - s] * np.uint64(7) + group[own])
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = own[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
            most[twice] = s
            least[twice[least[twice] < 0]] = s
    return most, least


def _grouped(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finished(rows: pa.Table) -> pa.RecordBatch:
            group = rows["h"].to_numpy().view(np.uint64)
            key, place = rows["key"].to_numpy(), rows["place"].to_numpy()
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])]) if len(group) else np.zeros(0, bool)  # a text that is there twice counts once
            rows, group, key, place = rows.filter(pa.array(new)), group[new], key[new], place[new]
            most, least = repeated_windows(group, rows["left"].to_pylist(), rows["right"].to_pylist(), rows["low"].to_numpy(), rows["high"].to_numpy(), length)
            own = most >= 0
            return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(place[own] - most[own]), pa.array(place[own] - least[own] + length)], ["key", "start", "stop"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if cut:
                yield finished(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield finished(held)

    return run


def _told_apart(rows: DataFrame, length: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(spans, rows with n) of large groups.

    Places whose bytes are the same through all windows of their range are repeated there,
    each a span; one of them stays to meet the others. n counts what then is left of a group;
    there are ``total`` rows.
    """
    width = length - digit(length)
    bytes_left = F.expr("substring(left, greatest(length(left) - high, 0) + 1, high)")
    bytes_right = F.expr(f"substring(right, 1, {width} - low)")
    each = rows.withColumnRenamed("h", "group").withColumn("h", F.xxhash64("group", "low", "high", bytes_left, bytes_right))
    same = each.groupBy("h").agg(F.count("*").alias("alike"), F.min(F.struct("key", "place")).alias("first"))
    joined = materialize(join_hot(each, "h", same.withColumnRenamed("h", "of"), "of", "alike", total).drop("h"))
    most, least = F.expr("least(high, length(left))"), F.expr(f"greatest(low, {width} - length(right))")
    spans = joined.where("alike > 1").select("key", (F.col("place") - most).alias("start"), (F.col("place") - least + length).alias("stop"), (most >= least).alias("fits")).where("fits").drop("fits")
    firsts = joined.where(F.struct("key", "place") == F.col("first")).drop("alike", "first").withColumnRenamed("group", "h")
    counts = firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return spans, materialize(firsts.join(counts, "h").select("h", "key", "place", "left", "right", "low", "high", "n"))


def _parted(rows: DataFrame, length: int) -> DataFrame:
    """Each row for the two halves of its windows, under a new digit: the bytes that all windows of a half share."""
    width = length - digit(length)
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    each = rows.where("low < high").select("h", "key", "place", "left", "right", F.inline(halves)).where(f"length(left) >= low and length(right) >= {width} - high")
    return each.withColumn("h", F.xxhash64("h", "low", F.expr("substring(left, length(left) - low + 1, low)"), F.expr(f"substring(right, 1, {width} - high)")))


def _flanks(length: int):
    k = digit(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                rows: list[list] = [[], [], [], [], [], []]
                for key, text, hashes, places, counts in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    raw = (text or "").encode("utf-8", "replace")
                    for h, p, n in zip(hashes, places, counts, strict=True):
                        for column, value in zip(rows, (h, key, p, raw[max(0, p - length + k) : p], raw[p + k : p + length], n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["h", "key", "place", "left", "right", "n"])

    return run


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans) of ``documents`` (doc_id, text).

    rows: doc_id, digest, n_bytes, sha256, copies (of that text) of every row. texts: digest
    and text of those with spans, at least once. spans: digest and spans, a list of (start,
    stop) in bytes that may overlap: for texts found once, all that repeated windows cover.
    """
    found = materialize(scanned(documents, length).withColumn("key", F.monotonically_increasing_id()))
    texts = found.groupBy("digest").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.min_by("doc_id", "key").alias("of"))
    known = materialize(texts)
    dealt = found.select("digest", "key", "hashes", "places").join(known.select("key", "copies"), "key")
    each = dealt.select("key", F.posexplode("hashes").alias("i", "h"), "places").select("h", "key", F.element_at("places", F.col("i") + 1).alias("place"))
    counts = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    shared = join_hot(each, "h", counts.withColumnRenamed("h", "of"), "of", "n", total).where("n is not null")
    seeds = shared.groupBy("key").agg(F.collect_list(F.struct("h", "place", "n")).alias("seeds"))  # fewer bytes than the text they are of
    seeds = materialize(seeds.join(known.select("key", "digest", "of"), "key"))
    texts_of = documents.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.col("doc_id").alias("of"), "text")
    own = split_by(texts_of, F.col("digest"), seeds, "digest")[1]
    held = own.join(seeds.withColumnsRenamed({"digest": "d", "of": "o"}), (F.col("digest") == F.col("d")) & F.col("of").eqNullSafe(F.col("o")))
    flanks = held.select("key", "text", F.col("seeds.h").alias("hashes"), F.col("seeds.place").alias("places"), F.col("seeds.n").alias("counts")).mapInArrow(_flanks(length), "h long, key long, place long, left binary, right binary, n long")
    flanks = materialize(flanks.withColumns({"low": F.lit(0), "high": F.lit(length - digit(length))}))  # read twice where there are large groups
    small = flanks.where(F.col("n") <= OFTEN)
    known_windows = None
    if (seeds.select(F.max(F.array_max("seeds.n")).alias("n")).first()["n"] or 0) > OFTEN:
        large = flanks.where(F.col("n") > OFTEN)
        if not found.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
            large = large.dropDuplicates(["h", "key", "place"])  # a text that is there twice counts once
        large = materialize(large.drop("n"))
        while not large.isEmpty():
            done, rest = _told_apart(large, length, large.count())
            known_windows = done if known_windows is None else known_windows.union(done)
            small = small.union(rest.where(F.col("n") <= OFTEN).select(*small.columns))
            large = materialize(_parted(rest.where(F.col("n") > OFTEN), length))
    ordered = small.repartition("h").sortWithinPartitions("h", "key", "place").select("h", "key", "place", "left", "right", "low", "high")
    spans = ordered.mapInArrow(_grouped(length), "key long, start long, stop long")
    spans = spans if known_windows is None else spans.union(known_windows)
    single = known.where("copies = 1").select("key", "digest", "of")
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(single, "key")
    rows = join_hot(found.select("doc_id", "digest", "n_bytes", "sha256"), "digest", known.select(F.col("digest").alias("same"), "copies"), "same", "copies", found.count())
    return rows, own, by_text.select("digest", "of", "spans")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the merged spans."""
    at, kept = 0, []
    for start, stop in spans:
        kept.append(raw[at:start])
        at = stop
    return b"".join([*kept, raw[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            for digest, text, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                merged = merge([(s["start"], s["stop"]) for s in spans])
                kept = cut(raw, merged)
                for column, value in zip(rows, (digest, sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


def _results(own: DataFrame, spans: DataFrame, kept: bool) -> DataFrame:
    held = own.join(spans.withColumnsRenamed({"digest": "d", "of": "o"}), (F.col("digest") == F.col("d")) & F.col("of").eqNullSafe(F.col("o")))
    out = held.select("digest", "text", "spans").mapInArrow(_removed, "digest string, n_removed long, n_spans long, kept_sha256 string, kept string")
    return (out if kept else out.drop("kept")).dropDuplicates(["digest"])


def measure(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents`` (doc_id, text).

    A byte is removed if a window of ``length`` bytes over it starts anywhere else too, in
    the same or another row, also overlapping; windows never cross texts. Null text is empty
    and keeps the empty string's hash; repeated rows remove each other when long enough; an
    empty table gives an empty one; other columns are ignored.
    """
    rows, own, spans = repeated_spans(documents, length)
    once = F.when(F.col("copies") == 1, F.col("digest")).otherwise(F.concat(F.lit("="), F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))  # copies have no spans, and go anywhere
    found = rows.withColumn("__once", once).join(_results(own, spans, False).withColumnRenamed("digest", "__once"), "__once", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return found.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def remove(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with the repeated passages cut out of text and n_chars set anew.

    Every row stays, with an empty text where all is removed; characters that a cut leaves
    in part go too. Columns and their order are kept; see ``measure`` for what is removed.
    """
    rows, own, spans = repeated_spans(documents, length)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    whole = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("digest", F.lit("").alias("kept"), "copies").distinct()
    changed = _results(own, spans, True).select("digest", "kept", F.lit(1).cast("long").alias("copies")).union(whole)
    changed = materialize(changed.select(F.col("digest").alias("__of"), F.col("kept").alias("__kept"), F.col("copies").alias("__copies")))
    clear, rest = split_by(documents.withColumn("__digest", digest), F.col("__digest"), changed, "__of")
    found = join_hot(rest, "__digest", changed, "__of", "__copies", rows.count())
    new = {"text": F.coalesce("__kept", "text")} | ({"n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    names = [f"`{c}`" for c in documents.columns]
    return clear.select(*names).union(found.withColumns(new).select(*names))

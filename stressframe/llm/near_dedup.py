"""Near-duplicates by Order MinHash.

A text is the sequence of its k-word shingles, each labelled by its occurrence. A sketch
takes the few labelled shingles of least hash and keeps them in text order, so texts share a
sketch when they share shingles in the same order, as texts at a small edit distance do.
Texts that share a sketch become candidates: all pairs of a small bucket; in larger ones, at
first, each text with those next to it when the bucket is ordered by another sketch, and with
the bucket's hub, the text whose buckets are fullest. Banded alignment of the shingle sequences
verifies them: aligned shingles over all, 0.8 or more. Links are then joined to classes by
large-star and small-star steps. Where a large bucket still holds several classes, all pairs
of different classes in it are compared, block by block. Equal texts are sketched once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, materialize, release, split_by

#: Parameters: words of a shingle, least similarity, (sketches, shingles of a sketch) of all texts and of short ones, shingles of a short text at most.
SHINGLE, SIMILAR = 5, 0.8
SKETCHES, SHORT_SKETCHES, SHORT = (40, 6), (12, 2), 50
#: Buckets up to this size give all pairs; in larger ones each text first meets so many before it, and the hub.
SMALL_BUCKET, BEFORE = 16, 2
#: Matches for each shingle up to which an alignment goes from match to match.
FEW = 4
#: Texts of a block when what is left of a larger bucket is compared, and shingles counted at a time.
BLOCK, COLUMNS = 256, 4096

_RNG = np.random.default_rng(7)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text; words end at ASCII white space."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    place = np.arange(len(raw)) - np.repeat(starts, lengths + 1)[: len(raw)]
    mixed = _stir(_LETTERS[raw] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed[raw == 32] = 0
    return _stir(np.add.reduceat(mixed, starts) + lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """A 64-bit hash of each shingle in order; fewer words than SHINGLE are one shingle, no words none."""
    words = word_numbers(text or "")
    n = len(words)
    if not n:
        return words
    k = min(SHINGLE, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = _stir(out + words[i : n - k + 1 + i] * _MIX[i])
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """Hashes that tell occurrences of equal shingles apart."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return x
    at = np.arange(len(x))
    times = np.empty(len(x), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _stir(x + times * np.uint64(0xD6E8FEB86659FD93))


def sketches(x: np.ndarray) -> np.ndarray:
    """Keys of the sketches of a sequence of shingles."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = labelled(x)
    out = []
    for family, (count, size) in enumerate((SKETCHES, SHORT_SKETCHES) if len(x) <= SHORT else (SKETCHES,)):
        size = min(size, len(x))
        step = max(1, min(count, 4_000_000 // len(x)))
        for start in range(0, count, step):
            multipliers = _ORDER[start : min(count, start + step)]
            hashes = _stir(x[None, :] * multipliers[:, None])
            least = np.sort(np.argpartition(hashes, size - 1, axis=1)[:, :size], axis=1)  # in text order
            key = (np.arange(start, start + len(multipliers)) + 64 * family).astype(np.uint64)
            for i in range(size):
                key = _stir(key * np.uint64(0x9E3779B97F4A7C15) + x[least[:, i]])
            out.append(key)
    return np.concatenate(out).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences within a band about the diagonal.

    Common ends are taken at once. The rest is the longest increasing chain of matches where
    matches are few, else (in texts that repeat themselves) a row of the table at a time in
    the bits of an integer; both give the same.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    way = _chained if int((right - left).sum()) <= FEW * (len(a) + len(b)) else _by_bits
    return head + tail + way(order, left, right, len(b), band)


def _chained(order: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, band: int) -> int:
    chain: list[int] = []
    for i in np.flatnonzero(right > left).tolist():
        for j in order[left[i] : right[i]][::-1].tolist():  # from the right, so that one shingle is used once
            if abs(i - j) <= band:
                at = bisect_left(chain, j)
                if at == len(chain):
                    chain.append(j)
                else:
                    chain[at] = j
    return len(chain)


def _by_bits(order: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, band: int) -> int:
    """A bit for each place of the second sequence in the band: 0 where the row's count goes up there."""
    band = min(band, max(n, len(left)))
    width = 2 * band + 1
    full = (1 << width) - 1
    row, low, found = full, -band, 0  # the band's bits now, the place of the lowest, ups that have left the band
    masks: dict[int, int] = {}  # of shingles with many places: all of them
    for i, (lo, hi) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if i - band > low:
            found += not row & 1
            row, low = row >> 1 | 1 << (width - 1), low + 1
        if hi - lo > 64:
            mask = masks.get(lo)
            if mask is None:
                bits = np.zeros(n, np.uint8)
                bits[order[lo:hi]] = 1
                mask = masks[lo] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            mask = (mask >> low if low >= 0 else mask << -low) & full
        else:
            mask = 0
            for j in order[lo:hi].tolist():
                if abs(i - j) <= band:
                    mask |= 1 << (j - low)
        if mask:
            met = row & mask
            row = ((row + met) | (row - met)) & full
    return found + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned shingles over all shingles of both, 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    common, x, y = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True), n, m
    if len(common) < need and len(common) + (n - len(np.unique(a))) < need:
        return 0.0
    got = aligned(a, b, int(x + y - 2 * need) + 1)  # more off the diagonal than this can't be aligned and similar
    return got / (n + m - got)


def digest(text: Column) -> Column:
    """What tells texts apart; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the text and keys of its sketches for every row with a doc_id."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = [sketches(shingles(t)) for t in part.column(2).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "digest", "keys"])

    return documents.select("doc_id", digest(F.col("text")).alias("digest"), "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, digest string, keys array<long>")


def distinct_texts(found: DataFrame) -> DataFrame:
    """id, digest, rep (the least doc_id), keys and copies of each text of ``sketched`` with a word; equal ones are joined in tasks first."""
    each = found.where(F.size("keys") > 0).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    return materialize(each.withColumn("id", F.monotonically_increasing_id()))


def buckets(texts: DataFrame) -> DataFrame:
    """key, id, other (the key that orders the bucket) and n of every bucket of two or more texts (id, keys)."""
    spread = texts.select("id", "keys", F.posexplode("keys").alias("i", "key")).select("key", "id", F.element_at("keys", (F.col("i") + 1) % F.size("keys") + 1).alias("other"))
    counts = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(spread.join(counts, "key"))


def candidates(shared: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of texts that share a bucket: all of a small one, neighbours and the hub of a larger one.

    Small buckets are dealt by key, larger ones by ranges of their order, so that none has to
    be in one task; the few neighbours that a range parts are left to ``remaining``.
    """
    large, small = shared.where(F.col("n") > SMALL_BUCKET), shared.where(F.col("n") <= SMALL_BUCKET)
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = large.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", "id"))["id"].alias("hub"))
    to_hub = large.join(hubs, "key").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last rows seen
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, doc, n = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            old = 0 if held is None else len(held[0])
            a, b = [], []
            for lag in range(1, SMALL_BUCKET):
                i = np.arange(max(lag, old), len(key))
                i = i[(key[i] == key[i - lag]) & ((n[i] <= SMALL_BUCKET) | (lag <= BEFORE))]
                a.append(doc[i])
                b.append(doc[i - lag])
            a, b = np.concatenate(a), np.concatenate(b)
            held = [x[-SMALL_BUCKET:] for x in (key, doc, n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    out = to_hub
    for rows in (small.repartition("key"), large.repartitionByRange("key", "other", "id")):
        ordered = rows.sortWithinPartitions("key", "other", "id").select("key", "id", "n")
        out = out.union(ordered.mapInArrow(near, "a long, b long"))
    return out.where("a < b").distinct()


def texts_of(documents: DataFrame, texts: DataFrame, ids: DataFrame, again: bool) -> DataFrame:
    """(id, text) of the ``texts`` whose id is among ``ids``; the texts of all other rows stay where they are.

    ``again`` says that a row may be there more than once.
    """
    named = texts.join(ids.distinct(), "id", "left_semi").select("id", F.col("digest").alias("of"), "rep", F.xxhash64("digest", "rep").alias("slot"))
    rows = documents.select(digest(F.col("text")).alias("digest"), "doc_id", "text")
    rows = split_by(rows, F.xxhash64("digest", "doc_id"), named, "slot")[1]
    out = rows.join(named, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("rep"))).select("id", "text")
    return out.dropDuplicates(["id"]) if again else out


def verified(pairs: DataFrame, documents: DataFrame, texts: DataFrame, again: bool = True) -> DataFrame:
    """The pairs whose texts are similar, with their similarity."""
    known = texts_of(documents, texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), again)
    left = pairs.join(known.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = left.join(known.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()

        def of(number: int, text: str) -> np.ndarray:
            found = known.pop(number, None)
            if found is None:
                found = shingles(text)
                if len(known) >= 512:
                    known.popitem(last=False)
            known[number] = found
            return found

        for batch in batches:
            a, b, s = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                s += [similarity(of(i, x), of(j, y)) for i, j, x, y in zip(a[start:], b[start:], part.column(2).to_pylist(), part.column(3).to_pylist(), strict=False)]
            kept = [k for k, v in enumerate(s) if v >= SIMILAR]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64()), pa.array([s[k] for k in kept], pa.float64())], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shingles that each row of ``left`` has in common with each of ``right``, repeated ones as often as both have them."""
    numbers, at = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    shared = np.bincount(at, minlength=len(numbers)) > 1
    place = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], place[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [start, start + COLUMNS])
        held = np.zeros((len(rows), COLUMNS), np.float32)
        held[owner[lo:hi], at[lo:hi] - start] = 1
        out += held[left] @ held[right].T
    return out


def compared(blocks: np.ndarray, ids: list, keys: list[np.ndarray], texts: list[np.ndarray], classes: list, key: int) -> list[tuple]:
    """Links (a, b) that join classes among the texts of one block, or between those of two.

    A pair is left to the bucket of the first sketch it shares, and one whose common
    shingles are too few is not aligned; neither loses a class.
    """
    first = blocks.min()
    left = np.flatnonzero(blocks == first)
    right = left if blocks.max() == first else np.flatnonzero(blocks != first)
    sizes = np.array([len(x) for x in texts])
    numbers = np.unique(np.array(classes), return_inverse=True)[1]
    need = SIMILAR * (sizes[left][:, None] + sizes[right][None]) / (1 + SIMILAR)
    fit = (overlaps([labelled(x) for x in texts], left, right) >= need - 1e-6) & (numbers[left][:, None] != numbers[right][None])
    if right is left:
        fit = np.triu(fit)
    roots = list(range(int(numbers.max()) + 1))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    links = []
    for i, j in zip(left[np.nonzero(fit)[0]].tolist(), right[np.nonzero(fit)[1]].tolist(), strict=True):
        p, q = root(numbers[i]), root(numbers[j])
        if p == q:
            continue
        n = min(len(keys[i]), len(keys[j]))
        same = np.flatnonzero(keys[i][:n] == keys[j][:n])
        if len(same) and keys[i][same[0]] == key and similarity(texts[i], texts[j]) >= SIMILAR:
            roots[p] = q
            links.append((ids[i], ids[j]))
    return links


def blocks_of(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, pairs of blocks to compare) of large buckets (key, id, class_id) with several classes.

    A class of BLOCK texts or more in a bucket has blocks of its own, the others share some;
    texts are dealt to blocks by a hash, from counts alone. Every two blocks of a bucket are
    a pair, but for those of one class.
    """
    sizes = materialize(large.groupBy("key", "class_id").agg(F.count("*").alias("size")))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1").select("key")
    named = sizes.join(mixed, "key", "left_semi").withColumn("home", F.when(F.col("size") >= BLOCK, F.col("class_id")).otherwise(F.lit(-1)))
    homes = named.groupBy("key", "home").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
    placed = large.join(named.select("key", "class_id", "home"), ["key", "class_id"]).join(homes, ["key", "home"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("key", "id", "class_id", "home", "part")
    other = homes.withColumnsRenamed({"key": "key2", "home": "home2", "parts": "parts2"})
    met = homes.join(other, (F.col("key") == F.col("key2")) & ((F.col("home") < F.col("home2")) | ((F.col("home") == F.col("home2")) & (F.col("home") == -1))))
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    met = met.where((F.col("home") < F.col("home2")) | (F.col("i") <= F.col("j"))).select("key", F.struct("home", "i").alias("first"), F.struct(F.col("home2").alias("home"), F.col("j").alias("i")).alias("second"))
    return placed, met


def remaining(shared: DataFrame, texts: DataFrame, documents: DataFrame, classes: DataFrame, again: bool = True) -> DataFrame:
    """Links (a, b) between texts of different ``classes`` (id, class_id) that share a large bucket.

    Each such bucket is cut in blocks; every two blocks that are not of one class only are
    compared in a task of their own, which hands on no more links than join classes.
    """
    large = shared.where(F.col("n") > SMALL_BUCKET).select("key", "id").join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    placed, met = blocks_of(materialize(large))
    placed, met = materialize(placed), materialize(met)
    each = met.select("key", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("own")).select("key", "first", "second", F.col("own.home").alias("home"), F.col("own.i").alias("part"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "shingles"])

    found = texts_of(documents, texts, placed.select("id"), again).mapInArrow(shingled, "id long, shingles array<long>")
    rows = placed.join(each, ["key", "home", "part"]).join(texts.select("id", "keys"), "id").join(found, "id")
    second = (F.col("home") == F.col("second.home")) & (F.col("part") == F.col("second.i"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = [[x.values.to_numpy() for x in group.column(c)] for c in ("keys", "shingles")]
        links = compared(group.column("block").to_numpy(), group.column("id").to_pylist(), lists[0], [x.view(np.uint64) for x in lists[1]], group.column("class_id").to_pylist(), group.column("key")[0].as_py())
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    chosen = rows.select("key", "first", "second", second.cast("int").alias("block"), "id", "class_id", "keys", "shingles")
    return chosen.groupBy("key", "first", "second").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) for every end of ``links`` (a, b): the least id it is joined to.

    Large-star and small-star steps until nothing changes; every step is a table in the
    shared folder, and the one before it goes.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    last, state = None, ()
    while state != last:
        last, before = state, edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialize(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(before)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("class_id"))).distinct()


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row of ``documents`` (doc_id, text).

    class_id is the least doc_id of the texts that are equal or linked, in steps, by a
    similarity of SIMILAR or more; kept marks the row whose doc_id it is. Texts without a
    word (null, empty, white space) stand alone, and are kept. Rows that repeat a doc_id
    with different texts are one document of all of them, and join their classes. A null
    doc_id has a null class and is kept. An empty table gives an empty one; other columns
    are ignored.
    """
    found = materialize(sketched(documents))
    ids = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("n > 1"))
    again, several = not ids.isEmpty(), ids.where("lo != hi").select("doc_id")
    texts = distinct_texts(found)
    shared = buckets(texts)
    links = materialize(verified(materialize(candidates(shared)), documents, texts, again).select("a", "b"))
    own = found.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(texts.select("digest", "id"), "digest")
    own = materialize(own.select("doc_id", "id", F.min("id").over(Window.partitionBy("doc_id")).alias("first")))
    more = own.where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))  # a doc_id with several texts joins their groups
    classes = components(links.union(more))
    further = materialize(remaining(shared, texts, documents, classes, again))
    if not further.isEmpty():
        classes = components(links.union(more).union(further))
    release(shared)
    rooted = texts.select("id", "digest", "rep", "copies").join(classes, "id", "left").withColumn("root", F.coalesce("class_id", "id")).drop("class_id")
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = materialize(rooted.join(least, "root").where("copies > 1 or class_id != rep").select("id", "digest", "class_id", "copies"))  # other texts are classes of their own
    joined = join_hot(found.select("doc_id", "digest"), "digest", named.drop("id").withColumnRenamed("digest", "of"), "of", "copies", found.count())
    out = joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    if again:  # rows of one doc_id have one class, that of its texts with words
        of_doc = own.groupBy("doc_id").agg(F.min("first").alias("id")).join(named, "id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("__class"))
        out = out.join(of_doc, "doc_id", "left").select("doc_id", F.coalesce("__class", "class_id").alias("class_id"))
    out = out.union(documents.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def keep(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` that ``deduplicate`` keeps; columns are kept.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays.
    """
    verdict = materialize(deduplicate(documents))
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    again = verdict.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__gone")).count().where("count > 1").drop("count")
    clear, rest = split_by(documents, documents["doc_id"], gone.union(again), "__gone")
    rest = rest.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if not again.isEmpty():
        named, other = rest.where("doc_id is not null"), rest.where("doc_id is null")
        rest = named.dropDuplicates(["doc_id"]).union(other)
    return clear.union(rest)

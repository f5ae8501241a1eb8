"""Best-fit packing by linear grouping.

Texts become token ids; those over the capacity are cut. How many pieces there are of each
length is all that the plan needs, so it is made on the driver from at most ``capacity``
counts: large lengths are dealt to groups of equal cardinality and rounded up to the largest
of the group; for these few sizes the configurations that fill a sequence best are found by
dynamic programming and used as often as the groups allow; actual lengths then take the
places of rounded ones, and small lengths go, longest first, where they fit best. The plan is
a table of ranges: the pieces of a length from one rank to another stand in a run of
sequences at one offset. Ranks come from counts of parts of a length, without a global sort.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Parameters: groups of large lengths, and the share of the capacity above which a length is large.
GROUPS, LARGE = 512, 1 / 8
END_ID = 2
#: White space besides the space and the line feed, and pairs of those two; texts with any of these are encoded whole.
ODD = ("\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "  ", " \n", "\n ", "\n\n") + tuple(chr(i) for i in range(0x2000, 0x200B))
Encode = Callable[[str], list[int]]


class Words:
    """Token ids of texts by their words, each encoded once.

    The tokenizer splits a text at single spaces and line feeds in any case, so the ids of
    a text are those of its words (with the space before them) in turn. Words are told
    apart by a 64-bit hash. At ``most`` words all are forgotten, which changes no result.
    """

    def __init__(self, encode: Encode, sizes: np.ndarray, special: tuple[str, ...] = (), most: int = 1_000_000) -> None:
        self.sizes = sizes  # bytes of each id
        self.encode, self.special, self.most = encode, special, most
        rng = np.random.default_rng(11)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.back = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.starts, self.lengths, self.flat = array("q"), array("q"), array("I")

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(raw):
            n = len(raw) * 5 // 4
            self.powers, self.back = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[raw] * self.powers[: len(raw)])])
        h = (sums[ends] - sums[starts]) * self.back[starts]
        return h ^ (h >> np.uint64(31)) ^ ((ends - starts).astype(np.uint64) << np.uint64(48))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, total, held = [], 0, []
        for i, t in enumerate(texts):
            if any(c in t for c in ODD) or any(s in t for s in self.special) or t[:1] == "\n":
                out[i] = np.array(self.encode(t), "<u4")
            elif not t:
                out[i] = np.zeros(0, "<u4")
            else:
                raw = t.encode("utf-8", "replace")
                plain.append(i)
                held.append(raw)
                total += len(raw)
            if total > 1 << 20 or (plain and i == len(texts) - 1):
                for j, ids in zip(plain, self._chunk(held), strict=True):
                    out[j] = ids
                plain, total, held = [], 0, []
        return out

    def _learn(self, words: list[bytes], keys: list[int]) -> None:
        """Encode new words in one call: a word begins with its space, or stands after a line feed put there; the tokens' bytes tell where it ends."""
        alone = [k for k, w in enumerate(words) if w == b" " or w == b"\n"]  # never between other words
        parts = [w if w[0] == 32 else b"\n" + w for w in words]
        for k in alone:
            parts[k] = b""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = np.cumsum(sizes)
        ids = np.array(self.encode(b"".join(parts).decode("utf-8")), np.uint32)
        edges = np.append(0, np.cumsum(self.sizes[ids]))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lengths[alone] = 0
        first, last = np.searchsorted(edges, stops - lengths), np.searchsorted(edges, stops)
        at, slot = len(self.flat), len(self.starts)
        self.flat.frombytes(ids.tobytes())
        counts = last - first
        for k in alone:
            own = self.encode(words[k].decode())
            first[k], counts[k] = len(self.flat) - at, len(own)
            self.flat.extend(own)
        self.starts.frombytes((first + at).tobytes())
        self.lengths.frombytes(counts.tobytes())
        self.slots.update(zip(keys, range(slot, slot + len(words)), strict=True))

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        cut = (raw == 32) | (raw == 10)
        cut[1:] |= raw[:-1] == 10
        at = np.cumsum([0] + [len(t) for t in texts])
        cut[at[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        hashes, first, word = np.unique(self._hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.slots) + len(hashes) > self.most:
            self.forget()
        slots, keys = self.slots, hashes.tolist()
        new = [k for k, key in enumerate(keys) if key not in slots]
        if new:
            begin = starts[first[new]]
            self._learn([joined[a:b] for a, b in zip(begin.tolist(), ends[first[new]].tolist(), strict=True)], [keys[k] for k in new])
        slot = np.fromiter(map(slots.__getitem__, keys), np.int64, len(keys))[word]
        n = np.frombuffer(self.lengths, np.int64)[slot]
        stop = np.cumsum(n)
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(np.frombuffer(self.starts, np.int64)[slot] - (stop - n), n) + np.arange(int(stop[-1]))]
        edges = np.append(0, stop)[np.append(np.searchsorted(starts, at[:-1]), len(starts))]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each id of a byte-level BPE file, where ids are in the order of the merges."""
    shown = [i for i in range(256) if chr(i).isprintable() and chr(i) != " " and i != 0xAD]
    hidden = [i for i in range(256) if i not in set(shown)]
    byte = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


def tokenizer(path: str) -> Words:
    """The ids that ``tokenizers`` gives with a byte-level BPE file.

    Texts with the string of a special token go to that library, which gives its id; for
    all others the same vocabulary is merged by tiktoken, which is several times as fast
    on single words. The tests compare the two.
    """
    import tiktoken
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    special = tuple(t.content for t in known.get_added_tokens_decoder().values())
    ranks = {b: i for b, i in byte_ranks(path).items() if b.decode("utf-8", "ignore") not in special}
    fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(b) for b in ranks]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return known.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return Words(encode, sizes, special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(i, capacity) for i in range(first, n, capacity)]


def pieces(documents: DataFrame, make: Callable[[], Words], capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row of ``documents``."""
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), words.many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw = np.append(ids, END_ID).astype("<u4").tobytes()
                    for k, (at, n) in enumerate(cut(len(raw) // 4, capacity)):
                        for column, value in zip(rows, (doc, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Ranges of the plan: (length, first rank, number, first sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
        self.rooms: list[int] = []  # those with runs, sorted

    def add_room(self, room: int, first: int, number: int) -> None:
        if room and number:
            if room not in self.room:
                self.room[room] = []
                insort(self.rooms, room)
            self.room[room].append((first, number))

    def place(self, length: int, rank: int, number: int) -> None:
        """Best fit for ``number`` pieces of a length, opening sequences where nothing fits."""
        while number:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                opened = -(-number // (self.capacity // length))
                self.add_room(self.capacity, self.sequences, opened)
                self.sequences += opened
                continue
            room = self.rooms[k]
            first, there = self.room[room].pop()
            if not self.room[room]:
                del self.room[room], self.rooms[k]
            taken = min(there, number)
            self.rows.append((length, rank, taken, first, self.capacity - room))
            self.add_room(room - length, first, taken)
            self.add_room(room, first + taken, there - taken)
            rank, number = rank + taken, number - taken


def best_configuration(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """How often each size is used beside one of ``first`` so that most of the capacity is filled, none more often than is left."""
    room = capacity - sizes[first]
    reach = np.full(room + 1, -1, np.int64)  # the size put in last
    reach[0] = len(sizes)
    for g in range(len(sizes)):
        spare = left[g] - (g == first)
        for _ in range(min(spare, room // sizes[g])):
            new = np.flatnonzero((reach[:-sizes[g]] >= 0) & (reach[sizes[g] :] < 0)) + sizes[g] if sizes[g] <= room else []
            if not len(new):
                break
            reach[new] = g
    used = [0] * len(sizes)
    used[first] = 1
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        used[reach[at]] += 1
        at -= sizes[reach[at]]
    for g in range(len(sizes)):
        used[g] = min(used[g], left[g])
    return used


def make_plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> Plan:
    """Plan for so many pieces of each length; uses nothing but the counts."""
    plan = Plan(capacity)
    lengths = sorted((n for n in counts if counts[n]), reverse=True)
    if lengths and lengths[0] == capacity:
        plan.rows.append((capacity, 0, counts[capacity], 0, 0))
        plan.sequences = counts[capacity]
    large = [n for n in lengths if LARGE * capacity < n < capacity]
    total = sum(counts[n] for n in large)
    each = max(1, -(-total // groups))
    dealt: list[list[list[int]]] = []  # of each group: runs [length, rank, number], longest first
    room = 0
    for n in large:
        rank = 0
        while rank < counts[n]:
            if not room:
                dealt.append([])
                room = each
            k = min(room, counts[n] - rank)
            dealt[-1].append([n, rank, k])
            rank, room = rank + k, room - k
    sizes, left = [g[0][0] for g in dealt], [sum(r[2] for r in g) for g in dealt]  # rounded up to the largest
    for first in range(len(sizes)):
        while left[first]:
            used = best_configuration(sizes, left, first, capacity)
            copies = min(left[g] // u for g, u in enumerate(used) if u)
            slots = [g for g, u in enumerate(used) for _ in range(u)]
            for g, u in enumerate(used):
                left[g] -= u * copies
            while copies:  # actual lengths take the places, as far as each run goes
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                run = min([copies] + [max(1, dealt[g][0][2] // need[g]) for g in need])
                at = 0
                for g in slots:
                    n, rank, there = dealt[g][0]
                    plan.rows.append((n, rank, run, plan.sequences, at))
                    at += n
                    dealt[g][0] = [n, rank + run, there - run]
                    if there == run:
                        dealt[g].pop(0)
                plan.add_room(capacity - at, plan.sequences, run)
                plan.sequences += run
                copies -= run
    for n in lengths:
        if n <= LARGE * capacity:
            plan.place(n, 0, counts[n])
    return plan


def pack(documents: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """Pack every whole text into sequences of at most ``capacity`` tokens.

    ``documents`` needs doc_id and text. A row for each piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Null and empty texts give one piece of the end token;
    repeated rows are packed each; pieces of one length are told apart by (doc_id, piece),
    and those alike are interchangeable; an empty table gives an empty one; other columns
    are ignored.
    """
    found = materialize(pieces(documents, lambda: tokenizer(path), capacity))
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    plan = make_plan(counts, capacity)
    rows = sorted(plan.rows) or [(0, 0, 0, 0, 0)]
    lengths, ranks, _, firsts, offsets = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    starts = np.searchsorted(lengths, np.arange(capacity + 2))
    parts = max(64, sum(counts.values()) // 200_000)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sums = dealt.groupBy("length", "part").count()
    before = sums.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("within", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    held = documents.sparkSession.sparkContext.broadcast((ranks, firsts, offsets, starts))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, firsts, offsets, starts = held.value
        for frame in frames:
            n, rank = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            at = np.empty(len(frame), np.int64)
            for length in np.unique(n):
                own = n == length
                a, b = starts[length], starts[length + 1]
                at[own] = a + np.searchsorted(ranks[a:b], rank[own], "right") - 1
            yield frame.assign(sequence_id=firsts[at] + rank - ranks[at], offset=offsets[at])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

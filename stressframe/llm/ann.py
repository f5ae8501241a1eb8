"""Approximate maximum inner product search with score-aware quantisation.

Equal vectors are one entry of the index, which keeps their smallest ids. Entries are dealt
to k-means cells; what is left after a cell's centre is coded with 16 centres for each pair
of dimensions (four bits), fitted so that error along the vector costs more than error
across it. A query reads the cells that should hold its nearest: products with the entries
of a cell scatter about that with its centre, as far as the cell is wide, so the number of
entries of each cell over the query's edge can be foretold; cells are read in the order of
the share of theirs that is over it. How far down that order a query reads, and how far a code
may err, isn't left to the forecast: both are measured on the true nearest of a sample of
queries, found by comparing these with every entry. In clustered tables the cells to read are
few; where vectors have no structure they are many. Codes are scanned by table look-up, two
at a time, and all entries that can be among the best by the error measured are scored again
on the original vectors.

Cells are read in bundles of a bounded number of entries: small cells share one, and a
large cell is cut by a hash of its entries, so no task holds a whole dense cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Parameters: floats and vectors of the training sample at most; sampled vectors for a cell at least; entries of a bundle about; queries of a block about.
SAMPLE_FLOATS, SAMPLE_VECTORS, PER_CELL, BUNDLE, QUERIES = 4_000_000, 20_000, 4, 8192, 16_384
#: Parameters: threshold of the score-aware loss; share of the nearest that the cells of a forecast are expected to hold.
THRESHOLD, EXPECTED = 0.2, 0.96
#: Parameters: queries compared with every entry; share of their nearest whose cells are to be read; factors tried on the forecast's deviation.
MEASURED, SHARE, FACTORS = 256, 0.99, (1.0, 2.0, 4.0, 8.0)


@dataclass
class Index:
    """Centres of cells (cells x d) and of the code (d/width x 16 x width), the mean that is taken off vectors first, and the scatter (d x d) within cells.

    Vectors are multiplied by ``scale``, so that float32 holds them.
    """

    cells: np.ndarray
    code: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray
    scale: float = 1.0

    @property
    def width(self) -> int:
        return self.code.shape[2]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x * self.scale - self.mean

    def stretch(self, unit: np.ndarray) -> np.ndarray:
        """Deviation within cells along each direction, against that along all."""
        along = ((unit @ self.scatter) * unit).sum(1)
        return np.sqrt(np.maximum(along, 0) / max(np.trace(self.scatter) / len(self.scatter), 1e-300))

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What cells and codes (a four-bit code for each part) stand for."""
        return self.cells[cell].astype(float) + self.code[np.arange(len(self.code)), codes].reshape(len(codes), -1)[:, : self.cells.shape[1]]


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % width)))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre by Euclidean distance, some rows at a time."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # so that no square is out of range
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def k_means(x: np.ndarray, k: int, steps: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def encode(rest: np.ndarray, unit: np.ndarray, code: np.ndarray, weight: float, passes: int = 2) -> np.ndarray:
    """Codes of ``rest`` by coordinate descent on |e|^2 + (weight - 1) <e, unit>^2, where e is the error."""
    m, _, w = code.shape
    r, u = rest.reshape(len(rest), m, w), unit.reshape(len(rest), m, w)
    codes = np.empty((len(rest), m), np.uint8)
    along = np.zeros((len(rest), m), np.float32)  # <e, unit> of each part
    plain = np.empty((len(rest), m, 16), np.float32)
    slant = np.empty_like(plain)
    for j in range(m):
        e = r[:, j, None, :] - code[j][None]
        plain[:, j], slant[:, j] = (e**2).sum(2), (e * u[:, j, None, :]).sum(2)
        codes[:, j] = plain[:, j].argmin(1)
        along[:, j] = np.take_along_axis(slant[:, j], codes[:, j, None].astype(np.int64), 1)[:, 0]
    total = along.sum(1)
    for _ in range(passes):
        for j in range(m):
            other = total - along[:, j]
            codes[:, j] = (plain[:, j] + (weight - 1) * (other[:, None] + slant[:, j]) ** 2).argmin(1)
            along[:, j] = np.take_along_axis(slant[:, j], codes[:, j, None].astype(np.int64), 1)[:, 0]
            total = other + along[:, j]
    return codes


def score_aware_weight(d: int) -> float:
    """Weight of parallel against orthogonal error for products over THRESHOLD of the norms."""
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def fit(x: np.ndarray, cells: int, width: int = 2, steps: int = 6) -> Index:
    """Fit cells and code on a bounded sample of vectors."""
    mean = x.mean(0, dtype=float)
    unit = _padded(directions(x), width)
    x = (x - mean).astype(np.float32)
    centres = k_means(x, cells)
    weight = score_aware_weight(x.shape[1])
    rest = x - centres[nearest(x, centres)]
    scatter = rest.astype(float).T @ rest.astype(float) / len(rest)
    rest = _padded(rest, width)
    rest, unit = rest[:8192], unit[:8192]
    m = rest.shape[1] // width
    code = np.stack([k_means(rest[:, j * width : (j + 1) * width], 16) for j in range(m)])
    r, u = rest.reshape(len(rest), m, width), unit.reshape(len(rest), m, width)
    for _ in range(steps):
        codes = encode(rest, unit, code, weight)
        error = r - code[np.arange(m), codes]
        along = (error * u).sum(2)
        for j in range(m):  # closed form of each centre with the other parts held
            other = along.sum(1) - along[:, j]
            for c in range(16):
                own = codes[:, j] == c
                if own.any():
                    uj, rj = u[own, j].astype(float), r[own, j].astype(float)
                    left = own.sum() * np.eye(width) + (weight - 1) * uj.T @ uj
                    right = rj.sum(0) + (weight - 1) * ((other[own] + (rj * uj).sum(1))[:, None] * uj).sum(0)
                    code[j, c] = np.linalg.solve(left, right)
            along[:, j] = ((r[:, j] - code[j, codes[:, j]]) * u[:, j]).sum(1)
    return Index(centres, code, mean, scatter)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def beyond(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution over ``z``, by a rational fit that is close in relative terms far out too."""
    #: Coefficients of the fit, lowest power first.
    powers = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + x / 2)
    total = np.zeros_like(t)
    for c in reversed(powers):
        total = total * t + c
    tail = t * np.exp(total - x * x) / 2
    return np.where(z >= 0, tail, 1 - tail)


def forecast(q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells in reading order, share of the ``k`` nearest foretold from each of these on) for each query.

    Products of a query with a cell's entries are taken as normal about the centre's, with
    ``scatter`` (queries x cells) as deviation.
    """
    about = q @ centres.T
    scatter = np.maximum(scatter, 1e-12)
    low, high = (about - 9 * scatter).min(1), (about + 9 * scatter).max(1)
    for _ in range(40):  # the edge over which k entries are expected
        middle = (low + high) / 2
        many = (sizes * beyond((middle[:, None] - about) / scatter)).sum(1) > k
        low, high = np.where(many, middle, low), np.where(many, high, middle)
    share = beyond((low[:, None] - about) / scatter)
    order = np.argsort(-share, axis=1, kind="stable")
    left = np.cumsum(np.take_along_axis(sizes * share, order, 1)[:, ::-1], axis=1)[:, ::-1]
    return order, left / np.maximum(left[:, :1], 1e-300)


def cells_to_read(q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, widths: np.ndarray, k: int, expected: float = EXPECTED) -> list[np.ndarray]:
    """For each query the cells that should hold ``expected`` of its ``k`` nearest, by the forecast alone.

    ``widths`` (of each cell, along a direction) times the query's length is the deviation.
    """
    order, left = forecast(q, centres, sizes, np.linalg.norm(q, axis=1)[:, None] * widths[None], k)
    return [np.sort(o[:m]) for o, m in zip(order, (left > 1 - expected).sum(1), strict=True)]


def reading_rule(q: np.ndarray, index: Index, sizes: np.ndarray, widths: np.ndarray, k: int, who: np.ndarray, cell: np.ndarray, share: float) -> tuple[float, float]:
    """(factor on the forecast's deviation, share left at which a query stops) by which the fewest entries are read.

    Entry i of ``cell`` is the cell of a true neighbour of query ``who[i]``; ``share`` of these are to be read.
    """
    best, rule = np.inf, (1.0, 0.0)
    for factor in FACTORS:
        order, left = forecast(q, index.cells.astype(float), sizes, factor * index.stretch(q)[:, None] * widths[None], k)
        place = np.argsort(order, axis=1)
        stop = float(np.sort(left[who, place[who, cell]])[int((1 - share) * len(cell))]) if len(cell) else 0.0
        read = (sizes[order] * (left >= stop)).sum()
        if read < best:
            best, rule = read, (factor, stop)
    return rule


def paired_tables(parts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Products of queries (parts of ``width`` each) with the 256 pairs of centres of every two neighbouring parts."""
    tables = np.einsum("qmw,mcw->qmc", parts, code)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
    return (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(tables), -1, 256)


def paired_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in each byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 1::2] * np.uint8(16) + codes[:, ::2]


def unpaired_codes(pairs: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` four-bit codes of each row of ``paired_codes``."""
    return np.stack([pairs & np.uint8(15), pairs >> np.uint8(4)], axis=2).reshape(len(pairs), -1)[:, :m].astype(np.int64)


def _rows(vectors: DataFrame, is_query: Column) -> tuple[DataFrame, int]:
    """(vec_id, v, query of the rows that take part, a row for each vec_id; length of the vectors, 0 if there are none)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = size[0]["d"] if size else 0
    rows = rows.where(F.size("v") == d)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    return rows, d


def _bundles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bundle, number of bundles) of each cell; small neighbours share one."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for c, n in enumerate(counts):
        if n > BUNDLE:
            at += held > 0
            first[c], parts[c] = at, -(-n // BUNDLE)
            at, held = at + parts[c], 0
            continue
        if held and held + n > BUNDLE:
            at, held = at + 1, 0
        first[c], held = at, held + n
    return first, parts


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, scanned: int = 128) -> DataFrame:
    """The ``k`` nearest of each query by inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Candidates are all rows but the query's own; null,
    zero and non-finite vectors, and those whose length isn't the commonest (ties: the
    shortest), take no part. Ties go to the smaller vec_id; equal vectors are exact ties.
    Repeated rows count once, and a vec_id with several vectors stands for the least of them.
    A query reads so many cells that ``share`` of the nearest of the queries measured are
    in them, all in a table of one bundle. ``scanned`` entries of each bundle of cells are
    scored on original vectors, and all others that by the largest error measured may be among
    its best. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, d = _rows(vectors, is_query)
    asked = materialize(rows.where("query").groupBy("v").agg(F.min("vec_id").alias("q"))) if d else None  # equal queries are asked once
    if not d or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = materialize(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    total, top = entries.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    bound = max(1, min(SAMPLE_VECTORS, SAMPLE_FLOATS // d))
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 32))
    drawn = entries.select("v", h.alias("h")).where(F.col("h") < int(min(1.0, 1.2 * bound / total + 64 / total) * (1 << 32)))  # about the bound: no task gathers more
    sample = np.array([r["v"] for r in drawn.orderBy("h", "v").limit(bound).collect()] or [entries.first()["v"]])
    scale = 2.0 ** min(-int(np.frexp(top)[1]), 1000)  # all components within one
    index = fit(sample * scale, int(max(1, min(round(total**0.5), len(sample) // PER_CELL))))
    index.scale = scale
    held = spark.sparkContext.broadcast(index)
    weight = score_aware_weight(d)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for frame in frames:
            if len(frame):
                x = _matrix(frame["v"])
                unit, x = directions(x).astype(np.float32), known.centred(x)
                cell = nearest(x.astype(np.float32), known.cells)
                rest = x - known.cells[cell]
                part = _padded(rest, known.width).astype(np.float32)
                codes = np.concatenate([encode(part[i : i + 2048], _padded(unit[i : i + 2048], known.width), known.code, weight) for i in range(0, len(x), 2048)])
                off = np.linalg.norm(x - known.decoded(cell, codes), axis=1)
                yield frame.assign(cell=cell, away=(rest**2).sum(1), off=off, codes=[c.tobytes() for c in paired_codes(codes)])

    base = materialize(entries.mapInPandas(coded, "v array<double>, ids array<long>, cell int, away double, off double, codes binary"))
    sizes, widths = np.zeros(len(index.cells), np.int64), np.zeros(len(index.cells))
    for r in base.groupBy("cell").agg(F.count("*").alias("n"), F.sum("away").alias("away")).collect():  # a row for each cell
        sizes[r["cell"]], widths[r["cell"]] = r["n"], (r["away"] / r["n"] / d) ** 0.5
    home, parts = _bundles(sizes)
    h = F.xxhash64("v", F.lit(1))
    drawn = [(r["q"], r["v"]) for r in asked.orderBy(h, "q").limit(MEASURED).collect()]
    numbers, q = [i for i, _ in drawn], np.array([v for _, v in drawn])
    unit = directions(q)
    tried = spark.sparkContext.broadcast((numbers, q, unit))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best entries of a batch for each query measured, by comparing all, and how far their codes fall short."""
        known, (numbers, q, unit) = held.value, tried.value
        for whole in frames:
            for at in range(0, len(whole), 4096):
                frame = whole.iloc[at : at + 4096]
                x, ids, cell, off = _matrix(frame["v"]), frame["ids"].to_numpy(), frame["cell"].to_numpy(), frame["off"].to_numpy()
                least = np.array([i[0] for i in ids])
                codes = unpaired_codes(np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), -1), len(known.code))
                missed = (known.centred(x) - known.decoded(cell, codes)) @ unit.T
                scores, out = x @ q.T, []
                for j, number in enumerate(numbers):
                    s = scores[:, j]
                    b = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k else np.arange(len(s))
                    b = b[np.lexsort((least[b], -s[b]))[: k + 1]]
                    b = b[[len(ids[i]) > 1 or ids[i][0] != number for i in b]]  # not the query itself
                    out.append(pd.DataFrame({"n": j, "score": s[b], "id": least[b], "cell": cell[b], "short": missed[b, j] / np.maximum(off[b], 1e-300)}))
                yield pd.concat(out)

    truly = base.mapInPandas(compared, "n int, score double, id long, cell int, short double")
    truly = truly.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    truly = truly.select("n", "cell", "short").collect()  # k rows for each query measured
    slack = max([r["short"] for r in truly] + [0.0])
    factor, stop = 1.0, 0.0
    if total > BUNDLE:
        factor, stop = reading_rule(unit, index, sizes, widths, k + 1, np.array([r["n"] for r in truly]), np.array([r["cell"] for r in truly]), share)
    table = spark.sparkContext.broadcast((sizes, widths, home, parts))

    def asked_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        sizes, widths, home, parts = table.value
        for frame in frames:
            out = []
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                unit = directions(_matrix(part["v"]))
                order, left = forecast(unit, known.cells.astype(float), sizes, factor * known.stretch(unit)[:, None] * widths[None], k + 1)
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                for q, v, cells, wanted in zip(part["q"], part["v"], order, (left >= stop) | (before <= k), strict=True):  # k + 1 entries at least
                    cells = np.sort(cells[wanted & (sizes[cells] > 0)])
                    for b in np.unique(home[cells]):
                        there = cells[home[cells] == b]
                        out += [(b + i, q, v, there) for i in range(parts[there[0]])]
            if out:
                yield pd.DataFrame(out, columns=["bundle", "q", "v", "cells"])

    def scan(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        known, out = held.value, []
        if len(queries) and len(entries):
            entries = entries.sort_values("cell", kind="stable")
            x = _matrix(entries["v"])
            codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(entries), -1)
            names, starts = np.unique(entries["cell"].to_numpy(), return_index=True)
            stops = np.append(starts[1:], len(entries))
            kept = min(len(entries), max(scanned, k + 1))
            ids, off = entries["ids"].to_numpy(), entries["off"].to_numpy()
            least = np.array([i[0] for i in ids])
            reach = slack * off + 1e-5 * (np.linalg.norm(known.centred(x), axis=1) + off)  # the last: float32 sums
            step = max(1, min(256, (1 << 23) // len(entries)))
            for start in range(0, len(queries), step):
                q = _matrix(queries["v"].iloc[start : start + step])
                unit = directions(q)
                tables = paired_tables(_padded(unit, known.width).reshape(len(q), -1, known.width).astype(np.float32), known.code)
                read = np.stack([np.isin(names, own) for own in queries["cells"].iloc[start : start + step]])
                about = (unit @ known.cells[names].T.astype(float)).astype(np.float32)
                near = np.full((len(q), len(entries)), -np.inf, np.float32)
                for c, (low, high) in enumerate(zip(starts, stops, strict=True)):  # only those who read the cell
                    own = np.flatnonzero(read[:, c])
                    if len(own):
                        part = np.repeat(about[own, c : c + 1], high - low, axis=1)
                        mine = tables if len(own) == len(q) else tables[own]
                        for j in range(codes.shape[1]):
                            part += mine[:, j].take(codes[low:high, j], axis=1)
                        near[own, low:high] = part
                best = np.argpartition(-near, kept - 1, axis=1)[:, :kept]
                for name, v, u, b, here in zip(queries["q"].iloc[start : start + step], q, unit, best, near, strict=True):
                    b = b[here[b] > -np.inf]
                    if len(b) > k:
                        edge = b[np.argpartition(-(x[b] @ v), k)[k]]  # k + 1 entries of the bundle are at least as near
                        b = np.union1d(b, np.flatnonzero(here + reach >= known.centred(x[edge]) @ u))
                    exact = np.einsum("nd,d->n", x[b], v)
                    top = np.lexsort((least[b], -exact))[: k + 1]
                    out.append(pd.DataFrame({"q": name, "score": exact[top], "ids": ids[b[top]]}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})

    asks = asked.mapInPandas(asked_of, "bundle int, q long, v array<double>, cells array<int>")
    query_blocks = max(1, -(-asked.count() // QUERIES))  # each reads a bundle anew
    places = spark.createDataFrame([(int(c), int(a), int(n)) for c, (a, n) in enumerate(zip(home, parts, strict=True))], "at int, home int, parts int")
    dealt = base.join(F.broadcast(places), F.col("cell") == F.col("at")).withColumn("bundle", (F.col("home") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int"))  # a row for each cell
    dealt = dealt.select("bundle", "v", "ids", "cell", "off", "codes", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    sent = asks.withColumn("query_block", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int"))
    key = ["bundle", "query_block"]
    found = sent.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(scan, "q long, score double, ids array<long>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    same = rows.where("query").select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "q")
    pairs = same.join(best, "q").where(F.col("query_id") != F.col("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")

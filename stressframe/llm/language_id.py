"""Language identification with string kernels.

A text is the set of character n-grams (orders 1 to 3, blended spectrum) of its
lower-cased letters, every other character being a word boundary. The kernel of two
texts is the number of n-grams present in both, normalised by the geometric mean of
their counts. Landmarks from a bounded training sample give a Nystrom map, in which
one-versus-rest ridge regression is solved; scoring is a product of a presence matrix and
the landmark matrix times the coefficients, for a batch of texts at a time.

Only n-grams that some landmark holds can add to a kernel value with a landmark, so these
are the columns of the presence matrix; all other n-grams of a text are counted, each once,
for the norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDETERMINED = "und"


@dataclass
class KernelModel:
    """A fitted model; ``coef`` maps landmark kernels to one score for each label."""

    labels: list[str]
    alphabet: np.ndarray  # code point -> 0 boundary, 1 unknown letter, then known letters, at last the separator of texts
    size: int  # numbers in use
    orders: int
    keys: np.ndarray  # sorted n-gram codes
    landmarks: np.ndarray  # n-grams x landmarks, columns of unit length
    coef: np.ndarray  # landmarks x labels

    def __post_init__(self) -> None:
        self._table = self._weights = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None, "_weights": None}

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Column of each n-gram code; the last column is for those that are no feature."""
        span = sum(self.size**n for n in range(1, self.orders + 1))
        if span <= 1 << 25:
            if self._table is None:
                self._table = np.full(span, len(self.keys), np.int32)
                self._table[self.keys] = np.arange(len(self.keys), dtype=np.int32)
            return self._table[codes]
        at = np.searchsorted(self.keys, codes)
        return np.where(np.append(self.keys, -1)[at] == codes, at, len(self.keys))

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams in each text (rows), and the root of the number of all its distinct n-grams."""
        width = len(self.keys) + 1
        x = np.zeros((len(texts), width), np.uint8)
        flat, others = x.reshape(-1), []
        for n, codes, points, rows in grams(texts, self.alphabet, self.size, self.orders):
            at = self.positions(codes)
            flat[rows * width + at] = 1
            rest = np.flatnonzero(at == len(self.keys))
            parts = [points[rest + i] for i in range(n)]
            whole = np.ones(len(rest), bool)
            code = np.full(len(rest), n, np.uint64)
            for p in parts:
                whole &= p != ord(SEPARATOR)
                code = code << np.uint64(20) | (p & np.uint64(0xFFFFF))  # letters have points under 2 ** 20
            others.append(_pairs(rows[rest[whole]], code[whole]))
        counts = x[:, :-1].sum(1, dtype=np.int64)
        if others:
            row, code = (np.concatenate(c) for c in zip(*others, strict=True))
            counts += np.bincount(_pairs(row, code)[0].astype(np.int64), minlength=len(texts))
        return x[:, :-1].astype(np.float32), np.sqrt(np.maximum(counts, 1))

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts (rows) with the landmarks."""
        x, norm = self.present(texts)
        return (x @ self.landmarks) / norm[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best label and its score from 0 to 1: half of one plus the regression's value for targets of -1 and 1, clipped."""
        if self._weights is None:
            self._weights = (self.landmarks.astype(np.float64) @ self.coef).astype(np.float32)
        x, norm = self.present(texts)
        scores = (x @ self._weights).astype(np.float64) / norm[:, None]
        best = scores.argmax(1)
        return [self.labels[i] for i in best], np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)


def _pairs(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a row and a code."""
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[new], codes[new]


SEPARATOR = "\ue000"  # between texts; a letter's number of its own, so that no n-gram across texts is a feature


def grams(texts: list[str], alphabet: np.ndarray, size: int, orders: int, piece: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, codes, points, row of each code) of every order over whole texts, about ``piece`` characters at a time.

    A code is made of the alphabet's numbers of its characters; points holds the characters
    themselves (0 for a boundary), from which the i-th code begins at the i-th. Codes across
    texts hold the separator.
    """
    held: list[str] = []
    rows: list[int] = []
    total = 0

    def flush():
        points = np.frombuffer(SEPARATOR.join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = letters = alphabet[points]
        points = np.where(letters > 0, points, 0).astype(np.uint64)
        row = np.repeat(np.array(rows, np.int32), [len(x) + 1 for x in held])[: len(letters)]
        offset = 0
        for n in range(1, orders + 1):
            if n > 1:
                offset += size ** (n - 1)
                code = code[:-1] * letters.dtype.type(size) + letters[n - 1 :]
            if len(code):
                yield n, code + letters.dtype.type(offset), points, row[: len(code)]

    for i, text in enumerate(texts):
        whole = f" {text.lower().replace(SEPARATOR, ' ')} "
        for start in range(0, max(1, len(whole) - orders + 1), piece):
            part = whole[start : start + piece + orders - 1]
            held.append(part)
            rows.append(i)
            total += len(part)
            if total >= piece:
                yield from flush()
                held, rows, total = [], [], 0
    if held:
        yield from flush()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, set(text)))


def fit(texts: list[str], labels: list[str], orders: int = 3, per_label: int = 32, ridge: float = 1e-3) -> KernelModel:
    """Fit on labelled texts, which the caller has bounded.

    ``per_label`` landmarks of each label are taken in the given order; all their n-grams
    are features.
    """
    pairs = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    texts, labels = [t for t, _ in pairs], [y for _, y in pairs]
    names = sorted(set(labels))
    if not names:
        return KernelModel([], np.zeros(0x110000, np.int16), 2, orders, np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    marks = [t for y in names for t in [t for t, z in pairs if z == y][:per_label]]
    letters = sorted({c for t in marks for c in set(t.lower()) if c.isalpha()})
    size = len(letters) + 3
    alphabet = np.zeros(0x110000, np.int32 if size**orders < 1 << 30 else np.int64)
    alphabet[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    for i, c in enumerate(letters):
        alphabet[ord(c)] = i + 2
    alphabet[ord(SEPARATOR)] = size - 1
    held = [np.unique(np.concatenate([np.zeros(0, np.int64)] + [codes for _, codes, _, _ in grams([t], alphabet, size, orders)])) for t in marks]  # one text at a time: no separator
    keys = np.unique(np.concatenate(held))
    model = KernelModel(names, alphabet, size, orders, keys, np.zeros((len(keys), len(marks)), np.float32), np.zeros((len(marks), len(names))))
    for j, own in enumerate(held):
        model.landmarks[np.searchsorted(keys, own), j] = 1 / np.sqrt(max(1, len(own)))
    among = model.landmarks.T.astype(np.float64) @ model.landmarks.astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # Nystrom map of a row of landmark kernels
    z = np.concatenate([model.kernels(texts[i : i + 128]) for i in range(0, len(texts), 128)]).astype(np.float64) @ root
    y = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0)
    weight = np.array([len(labels) / labels.count(label) for label in labels])[:, None]  # labels count alike
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * weight.sum() * np.eye(z.shape[1]), z.T @ (weight * y))
    model.coef = root @ solved
    return model


def training_sample(labelled: DataFrame, per_label: int = 256, max_rows: int = 4096, max_chars: int = 20_000) -> DataFrame:
    """At most ``per_label`` rows of a label and ``max_rows`` in all, the first by a hash of text; texts over ``max_chars`` characters teach nothing.

    ``labelled`` has text and lang. Equal texts of a label count once; they are joined within
    tasks, and ranks are cut in parts of a label first.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.length("text") <= max_chars).select("lang", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2")).distinct()
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("h2", F.lit(64))).orderBy("h", "h2"))).where(F.col("rank") <= per_label).drop("rank")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "h2"))).where(F.col("rank") <= per_label)
    picked = first.orderBy("rank", "lang").limit(max_rows).select("lang", "h", "rank")
    keyed = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    return keyed.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h", "rank"]).select("rank", "lang", "text")


def train(labelled: DataFrame, **options) -> KernelModel:
    """Fit on the bounded sample of ``labelled`` (text, lang)."""
    names = {k: options.pop(k) for k in ("per_label", "max_rows", "max_chars") if k in options}
    rows = sorted(training_sample(labelled, **names).collect(), key=lambda r: (r["lang"], r["rank"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identify(documents: DataFrame, model: KernelModel, passed: list[str] | None = None, batch: int = 128) -> DataFrame:
    """Predict the language of every whole text.

    ``documents`` needs text; ``passed`` columns go through. Adds lang_pred and score, in
    place of columns so called.
    Null text, or text without a letter, gives 'und' and 0; so does any text where the
    model has no label. Equal and repeated rows are scored alike, an empty table gives
    an empty one, and other columns are ignored.
    """
    spark = documents.sparkSession
    passed = [c for c in (passed if passed is not None else ["doc_id"]) if c not in ("lang_pred", "score")]
    held = spark.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for frame in frames:
            texts = frame.pop("text")
            labels, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            usable = [i for i, t in enumerate(texts) if known.labels and has_letter(t)]
            for start in range(0, len(usable), batch):
                own = usable[start : start + batch]
                labels[own], scores[own] = known.predict([texts.iloc[i] for i in own])
            yield frame.assign(lang_pred=labels, score=scores)

    chosen = documents.select(*passed, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return chosen.mapInPandas(score, f"{schema}, lang_pred string, score double")

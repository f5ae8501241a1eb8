"""Quality rules by distribution divergence.

Every whole text gives two histograms: classes of its characters, and the common words it
uses. The histograms of a language's texts, added up, are its references, and a text is held
against them by the Jensen-Shannon distance (base 2, from 0 to 1). For characters there is a
limit on the distance. The distance of words is that of a sample: it falls with the root of
the number of words, so it is multiplied by it, and the limit of a language is the median of
its own texts and so many times their median deviation from it. Both are robust: references
and limits stand while junk is the smaller part, though it is counted among the rest.

Short texts scatter, so a guard on length comes before each test; languages of few texts
have no reference and no such test; a text of no known language is held against the language
it is nearest to. Plain rules on length and repetition come first, and what they reject is
in no reference.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Common words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou elle nous leur aux cette ses été être deux même tout".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también".split(),
}
WORD_BINS = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))}  # bin 0: any other word
CHARACTER_CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: Parameters: largest distance of characters, and the least length at which it counts.
MAX_CHARACTER_DISTANCE, MIN_CHARACTERS = 0.2, 200
#: Parameters: median deviations over the median of the distance of words times the root of their number, the least limit, the least length at which it counts.
DEVIATIONS, LEAST_LIMIT, MIN_WORDS = 7.0, 3.0, 50
#: Parameter: texts that make a reference.
MIN_REFERENCE_TEXTS = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    out = np.full(0x110000, CHARACTER_CLASSES.index("other"), np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = CHARACTER_CLASSES.index("upper" if c.isupper() else "lower")
        elif c.isdigit():
            out[i] = CHARACTER_CLASSES.index("digit")
        elif c.isspace():
            out[i] = CHARACTER_CLASSES.index("space")
    for c in ".,;:!?'\"()-":
        out[ord(c)] = CHARACTER_CLASSES.index("stop")
    for c in SYMBOLS.decode() + "@^~`{}[]\\/_=+":
        out[ord(c)] = CHARACTER_CLASSES.index("symbol")
    return out


_TABLE: list[np.ndarray] = []


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words in windows of ``window`` (a power of two) words that are found twice or more.

    Windows get numbers by doubling: equal numbers stand for equal windows.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == n:
        return 0
    step = 1
    while step < window:
        ids = np.unique(ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(often):
        return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, often, 1)
    np.add.at(marks, often + window, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters by class, words by bin)."""
    text = text or ""
    if not _TABLE:
        _TABLE.append(_classes())
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    characters = np.bincount(_TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(CHARACTER_CLASSES))
    bins = np.zeros(len(WORD_BINS) + 1, np.int64)
    get = WORD_BINS.get
    np.add.at(bins, [get(w, 0) for w in re.findall(r"\w+", text.lower())], 1)
    return len(words), len(text) - spaces, symbols, again, repeated_words(words), characters, bins


_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, characters array<long>, words array<long>"


def features(documents: DataFrame, *carried: Column) -> DataFrame:
    """What ``measure`` gives for each whole text, lang, and the ``carried`` columns, which stay where they are; base_failed is the plain rules' verdict."""

    @F.pandas_udf(_MEASURED)
    def found(text: pd.Series) -> pd.DataFrame:
        rows = [measure(t) for t in text]
        return pd.DataFrame({name: [r[i] for r in rows] for i, name in enumerate((*COUNTS, "characters", "words"))})

    each = documents.select(*carried, F.col("lang").alias("__lang"), found("text").alias("__m"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return each.select("*", "__m.*").drop("__m").withColumn("base_failed", failed)


def _sums(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(name)[i]) for i in range(n))).alias(f"{name}_reference")


def references(found: DataFrame) -> DataFrame:
    """The added histograms of each language with enough texts that passed the plain rules; a row for each."""
    sums = [_sums("characters", len(CHARACTER_CLASSES)), _sums("words", len(WORD_BINS) + 1), F.count("*").alias("texts")]
    return found.where("__lang is not null and not base_failed").groupBy("__lang").agg(*sums).where(F.col("texts") >= MIN_REFERENCE_TEXTS)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the same row of reference; 0 where one is empty."""
    filled = (counts.sum(1) > 0) & (reference.sum(1) > 0)
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (counts.astype(float), reference.astype(float)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)) / 2
    return np.where(filled, np.sqrt(np.clip(total, 0, 1)), 0)


def _from_own(known: dict, lang: list, counts: np.ndarray, i: int) -> np.ndarray:
    """Distance of each row of counts to histogram ``i`` of its language; the least to any for a null language, nan without a reference."""
    out = np.full(len(counts), np.nan)
    own = [k for k, x in enumerate(lang) if x in known]
    if own:
        out[own] = distances(counts[own], np.stack([known[lang[k]][i] for k in own]))
    if known:
        every = np.stack([x[i] for x in known.values()])
        for k in (k for k, x in enumerate(lang) if x is None):
            out[k] = distances(np.broadcast_to(counts[k], every.shape), every).min()
    return out


def measured_distances(found: DataFrame) -> DataFrame:
    """``found`` (of ``features``) with character_distance and word_distance, null below the guards on length and without a reference, and excess: the latter times the root of the number of words.

    The references reach the driver and all tasks: two short rows of numbers a language.
    """
    rows = references(found).collect()
    held = found.sparkSession.sparkContext.broadcast({r["__lang"]: (np.array(r["characters_reference"]), np.array(r["words_reference"])) for r in rows})

    @F.pandas_udf("character double, word double")
    def far(lang: pd.Series, characters: pd.Series, words: pd.Series) -> pd.DataFrame:
        lang = [None if pd.isna(x) else x for x in lang]
        if not len(lang):
            return pd.DataFrame({"character": pd.Series(dtype=float), "word": pd.Series(dtype=float)})
        out = []
        for at in range(0, len(lang), 1024):  # histograms are wide, and a distance takes several copies of them
            some = slice(at, at + 1024)
            out.append(pd.DataFrame({name: _from_own(held.value, lang[some], np.stack(counts.to_numpy()[some]), i) for i, (name, counts) in enumerate((("character", characters), ("word", words)))}))
        return pd.concat(out, ignore_index=True)

    far = far.asNondeterministic()  # else filters repeat it, and a task then takes a second Python worker
    each = found.withColumn("__far", far("__lang", "characters", "words")).withColumn("__n", F.aggregate("words", F.lit(0).cast("long"), lambda a, v: a + v))
    size = F.aggregate("characters", F.lit(0).cast("long"), lambda a, v: a + v)
    at = lambda c, ok: F.when(ok & ~F.isnan(c), c)
    each = each.withColumns({"character_distance": at(F.col("__far.character"), size >= MIN_CHARACTERS), "word_distance": at(F.col("__far.word"), F.col("__n") >= MIN_WORDS)})
    return each.withColumn("excess", F.col("word_distance") * F.sqrt("__n")).drop("__far", "__n")


def word_limits(found: DataFrame) -> DataFrame:
    """of and limit: for each language, and for null, the largest ``excess`` that is let through.

    Medians are exact for values to two places, of which there are few, so the state of the
    percentile is small whatever the number of texts.
    """
    each = found.where("excess is not null and not base_failed").select("__lang", F.round("excess", 2).alias("v"))
    each = each.select(F.explode(F.array_distinct(F.array("__lang", F.lit(None).cast("string")))).alias("__of"), "v")  # null: of all
    middle = each.groupBy("__of").agg(F.percentile("v", 0.5).alias("median"))
    away = each.join(middle.withColumnRenamed("__of", "__mid"), F.col("__of").eqNullSafe(F.col("__mid"))).select("__of", "median", F.round(F.abs(F.col("v") - F.col("median")), 2).alias("a"))
    return materialize(away.groupBy("__of", "median").agg(F.percentile("a", 0.5).alias("deviation")).select("__of", F.greatest(F.col("median") + DEVIATIONS * F.col("deviation"), F.lit(LEAST_LIMIT)).alias("limit")))


def _verdicts(found: DataFrame) -> DataFrame:
    each = measured_distances(found)
    each = each.join(word_limits(each), F.col("__lang").eqNullSafe(F.col("__of")), "left")
    far = F.coalesce(F.col("character_distance") > MAX_CHARACTER_DISTANCE, F.lit(False)) | F.coalesce(F.col("excess") > F.col("limit"), F.lit(False))
    return each.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(documents: DataFrame) -> DataFrame:
    """Counts and verdict for every row of ``documents`` (doc_id, text, lang).

    base_failed: under 20 words, or over 30 % of them in repeated windows of eight words.
    kept: not base_failed, and each tested distance within its limit. Null text counts as
    empty and fails; with a null language the least distance to any reference counts, and
    a language of under MIN_REFERENCE_TEXTS texts has no reference, so no distance is tested.
    Equal texts of a language are judged alike, repeated rows each get a row, an empty table
    gives an empty one, and other columns are ignored.
    """
    found = materialize(features(documents, F.col("doc_id")))
    return _verdicts(found).select("doc_id", *COUNTS, "base_failed", "kept", "character_distance", "word_distance")


def keep(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` that ``judge`` keeps; columns are kept.

    Every text is measured once, where it stands: rows are written with their counts, and
    judged from these. Cases are as in ``judge``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])  # whatever the columns are called
    return _verdicts(materialize(features(documents, row.alias("__row")))).where("kept").select("__row.*")

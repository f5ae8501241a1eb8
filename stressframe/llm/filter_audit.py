"""Filter interaction audit: which filters of a corpus overlap, in every order in which they could run.

Five filters fail a document or not. The failures of a document are a mask of five bits, and
how often each of the 32 masks occurs in a part of the corpus answers every question about
every order of the filters: what each step removes, what it finds already removed, and what
its share is over all orders. So texts are read once, and the rest works on 32 cells a part.
All of it is DataFrame functions.

Odd input: a null text is empty, a null source is the part "" (as is an empty one), a null
doc_id has no label and is no smaller and no larger than another, so it fails no E and makes
no other fail it; rows that repeat a doc_id count each, of equal ones none is smaller; of
several labels of a doc_id one that says so is enough; an empty table has no parts and gives
no rows; columns of the table other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Per cent of words that differ, at least; of capital letters, at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CELLS = 1 << len(FILTERS)


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of A to D for a text that is not null; words are split once."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def judged(w: Column) -> Column:
        n, capitals = F.size(w), F.length(text) - F.length(F.translate(text, CAPITALS, ""))
        fails = (
            ("A", n < MIN_WORDS),
            ("B", F.size(F.array_distinct(w)).cast("long") * 100 < n.cast("long") * LEAST_DISTINCT),
            ("C", capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS),
            ("D", text.rlike(SYMBOLS)),
        )
        return sum((F.when(failed, bit(k)).otherwise(0) for k, failed in fails), F.lit(0))

    return F.transform(F.array(words), judged)[0]  # an array of one, so that the words are bound


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part and mask of every document.

    The text itself is gone after the first scan; equal texts are found by their SHA-256.
    Grouping them gives the least doc_id of each text that occurs twice or more; keys of a
    large share of the rows are joined apart, so no task gets all copies of one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(documents.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_mask(text).alias("own")))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = join_hot(rows, "digest", copies, "digest", "n", rows.count())
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marked.select("doc_id", "part", (F.col("own") + F.when(copied, bit("E")).otherwise(0)).alias("mask"))


def histogram(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: how many documents of a part have a mask, and how they are labelled."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(documents).join(said, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """Every order, step, the bits of the filters before it, and its own bit."""
    return [("".join(order), k + 1, sum(bit(c) for c in order[:k]), bit(order[k])) for order in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A step depends on the set of filters before it alone, of which there are 16 for a filter:
    80 sums over the cells of a part, dealt to its 600 steps by a join on that set.
    """
    steps = _steps()
    sets = sorted({(before, own) for _, _, before, own in steps})
    spark, n = documents.sparkSession, len(FILTERS)
    cells = histogram(documents, labels)
    fixed = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in sets))
    at = cells.select("*", F.explode(fixed).alias("at")).select("*", "at.before", "at.own")
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda which, of="n": F.sum(F.when(which, F.col(of)).otherwise(0))
    sums = at.groupBy("part", "before", "own").agg(
        count(passed & ~fails).alias("kept"), count(passed & fails).alias("removed"), count(~passed & fails).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(passed & fails, "good").alias("good_lost"), count(passed & fails, "toxic").alias("toxic_lost"),
    )
    behind = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), behind.cast("int") + 1)  # in which just these come before
    shares = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, own int"))  # 600 rows
    out = sums.join(shares, ["part", "own"]).join(table, ["before", "own"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marked AS (SELECT d.doc_id, d.part, CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(d.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.t, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > f.first THEN 16 ELSE 0 END AS mask FROM d JOIN firsts f ON d.t = f.t),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM marked LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT substr('{FILTERS}', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)),
orders AS (SELECT '' AS o UNION ALL SELECT o || letter FROM orders, letters WHERE position(letter IN o) = 0),
steps AS (SELECT o AS filter_order, k AS step, (SELECT coalesce(sum(bit), 0) FROM letters WHERE position(letter IN substr(o, 1, k - 1)) > 0)::INT AS before, (SELECT bit FROM letters WHERE letter = substr(o, k, 1)) AS own
    FROM orders, (SELECT unnest(range(1, 6))::INT AS k) WHERE length(o) = 5),
found AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & before = 0 AND mask & own = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found
"""

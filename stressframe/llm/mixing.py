"""Temperature mixing of sources, in DataFrame functions alone.

A source with the token share p gets the weight p ** alpha, normalised. The exponent is
bisected: it is the one that meets the target entropy, or a larger one where the limit on
repetition asks for it. Weights become token budgets, and budgets are filled by passes over
the source: each pass is a permutation of its documents in random blocks, and the last is
cut where the budget ends. Without a budget the mix is the smallest that has every document
at least once, so nothing is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Parameters: target entropy as a share of the largest, passes over a source at most, steps of the bisection, documents of a block about.
ENTROPY_SHARE, MAX_REPEATS, STEPS, BLOCK_ROWS = 0.98, 1.25, 60, 4096
#: Tables of sources up to this many rows are broadcast, and their exponent is found on one row; larger ones are joined by a shuffle, and aggregated in each round.
BROADCAST_SOURCES = 10_000
#: Halvings of a round.
LEVELS = 4
SEED = "mix"


def token_estimate(text: Column) -> Column:
    """A token for every four bytes begun, one at least; null counts as empty."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _exponent(sizes: DataFrame, entropy_share: float, max_repeats: float, budget: int | None) -> DataFrame:
    """alpha, most and sum (of the powers): one row. The tokens of all sources, up to BROADCAST_SOURCES, stand in one row."""
    all_of = sizes.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("all"))
    most, least, number = F.element_at("all", -1), F.element_at("all", 1), F.size("all")

    def powers(alpha: Column) -> Column:
        return F.transform("all", lambda v: F.pow(v / most, alpha))

    def entropy(alpha: Column) -> Column:
        w = powers(alpha)
        shares = F.transform(F.array(_total(w)), lambda s: F.aggregate(w, F.lit(0.0), lambda a, v: a - v / s * F.ln(v / s)))
        return F.element_at(shares, 1)

    def repeats(alpha: Column) -> Column:
        if budget is None:
            return F.pow(most / least, 1 - alpha)
        return F.lit(float(budget)) * F.pow(least / most, alpha) / _total(powers(alpha)) / least

    def flat(alpha: Column) -> Column:
        return (repeats(alpha) > max_repeats) | (entropy(alpha) > entropy_share * F.ln(number.cast("double")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: F.struct(F.when(flat((s["low"] + s["high"]) / 2), (s["low"] + s["high"]) / 2).otherwise(s["low"]).alias("low"), F.when(flat((s["low"] + s["high"]) / 2), s["high"]).otherwise((s["low"] + s["high"]) / 2).alias("high")))
    return all_of.where(number > 0).select(halved["high"].alias("alpha"), most.alias("most"), _total(powers(halved["high"])).alias("sum"))


def _exponent_by_rounds(sizes: DataFrame, entropy_share: float, max_repeats: float, budget: int | None) -> DataFrame:
    """What ``_exponent`` gives, for any number of sources: each round is one aggregation for all exponents that LEVELS halvings may try."""
    tokens = F.col("tokens").cast("double")
    ends = sizes.agg(F.max(tokens).alias("most"), F.min(tokens).alias("least"), F.count("*").alias("number")).first()
    most, least, number = ends["most"], ends["least"], ends["number"]
    low, high = 0.0, 1.0
    for done in range(0, STEPS, LEVELS):
        tried = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        power = [F.pow(tokens / most, F.lit(a)) for a in tried]
        sums = sizes.agg(*(F.sum(p) for p in power), *(F.sum(p * F.ln(p)) for p in power)).first()
        for _ in range(min(LEVELS, STEPS - done)):
            middle = (low + high) / 2
            k = min(range(len(tried)), key=lambda i: abs(tried[i] - middle))
            total, inner = sums[k], sums[len(tried) + k]
            entropy = math.log(total) - inner / total
            again = (most / least) ** (1 - middle) if budget is None else budget * (least / most) ** middle / total / least
            if again > max_repeats or entropy > entropy_share * math.log(number):
                low = middle
            else:
                high = middle
    return sizes.agg(F.lit(high).alias("alpha"), F.lit(most).alias("most"), F.sum(F.pow(tokens / most, F.lit(high))).alias("sum"))


def weights(sizes: DataFrame, entropy_share: float, max_repeats: float, budget: int | None) -> DataFrame:
    """key, tokens, rows, alpha, weight, repeats and budget of each source of ``sizes`` (key, tokens, rows)."""
    sizes = materialize(sizes)
    way = _exponent if sizes.count() <= BROADCAST_SOURCES else _exponent_by_rounds
    w = sizes.crossJoin(F.broadcast(way(sizes, entropy_share, max_repeats, budget)))  # one row
    w = w.withColumn("weight", F.pow(F.col("tokens") / F.col("most"), F.col("alpha")) / F.col("sum"))
    passes = F.pow(F.col("most") / F.col("tokens"), 1 - F.col("alpha")) if budget is None else F.lit(float(budget)) * F.col("weight") / F.col("tokens")
    w = w.withColumn("repeats", passes)
    return w.select("key", "tokens", "rows", "alpha", "weight", "repeats", F.ceil(F.col("tokens") * F.col("repeats") - 1e-6).cast("long").alias("budget"))


def _small(sources: DataFrame) -> DataFrame:
    """The table, computed; to be broadcast if its counted rows allow."""
    known = materialize(sources)
    return F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known


def _permuted(rows: DataFrame) -> DataFrame:
    """Adds epoch, h and block to rows with key, doc_id, n_tokens and what ``weights`` gives; a row for each pass begun."""
    begun = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("tokens"))).cast("int")
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), begun - 1)))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("epoch").cast("string"), F.lit("/" + SEED)).cast("binary"))
    blocks = F.floor(F.col("rows") / BLOCK_ROWS).cast("long") + 1
    return each.withColumn("h", h).withColumn("block", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % blocks)


def realise(documents: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """The mix as places: doc_id, source, epoch, block, position, n_tokens, weight.

    ``documents`` needs doc_id, source and text. position counts the tokens of the source
    before the document, over all passes. Null sources are one source; null or empty texts
    count one token; rows that repeat a doc_id are placed each, in any order; an empty table
    gives an empty one; other columns are ignored.
    """
    rows = documents.select("doc_id", "source", _key(F.col("source")).alias("key"), token_estimate(F.col("text")).alias("n_tokens"))
    sizes = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = _placed(rows, _small(weights(sizes, entropy_share, max_repeats, budget)))
    return placed.select("doc_id", "source", F.col("epoch").cast("int"), F.col("block").cast("long"), "position", "n_tokens", F.round("weight", 9).alias("weight"))


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    each = _permuted(rows.join(known, "key"))
    sums = each.groupBy("key", "epoch", "block").agg(F.sum("n_tokens").alias("in_block"))
    ahead = Window.partitionBy("key", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "epoch", "block", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("key", "epoch", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = each.withColumn("within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(bases, ["key", "epoch", "block"])
    return within.withColumn("position", F.col("epoch") * F.col("tokens") + F.col("base") + F.col("within")).where(F.col("position") < F.col("budget"))


def mix(documents: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """``documents`` with every row as often as the mix has it; columns are kept.

    The places of ``realise`` say where the last pass over each source is cut; rows are then
    repeated where they stand, without moving texts. Cases are as there.
    """
    names = documents.columns
    rows = documents.select("doc_id", _key(F.col("source")).alias("key"), token_estimate(F.col("text")).alias("n_tokens"))
    sizes = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    known = _small(weights(sizes, entropy_share, max_repeats, budget))
    last = _placed(rows, known).groupBy("key", "epoch").agg(F.max(F.struct("block", "h")).alias("last"))
    ends = _small(known.join(last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "last"))).alias("ends")), "key"))  # a row for each source
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "doc_id", _key(F.col("source")).alias("key"))  # whatever the columns are called
    return _permuted(packed.join(ends, "key")).where(F.struct("block", "h") <= F.col("ends")[F.col("epoch")]).select("__row.*")


#: The SQL of ``realise`` on the table documents.
SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n_tokens
  FROM documents),
sizes AS (SELECT key, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n FROM rows_ GROUP BY key),
all_of AS (SELECT max(tokens) AS most, min(tokens) AS least, count(*) AS number FROM sizes),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END FROM (
    SELECT b.step, b.low, b.high, (b.low + b.high) / 2 AS mid,
      (SELECT pow(most / least, 1 - (b.low + b.high) / 2) FROM all_of) > {MAX_REPEATS}
      OR (SELECT -sum(p / s * ln(p / s)) FROM (SELECT pow(tokens / most, (b.low + b.high) / 2) AS p, sum(pow(tokens / most, (b.low + b.high) / 2)) OVER () AS s FROM sizes, all_of)) > (SELECT {ENTROPY_SHARE} * ln(number) FROM all_of) AS flat
    FROM bisect b WHERE b.step < {STEPS})),
alpha AS (SELECT high AS alpha FROM bisect WHERE step = {STEPS}),
known AS (
  SELECT key, tokens::BIGINT AS tokens, n, pow(tokens / most, alpha) / sum(pow(tokens / most, alpha)) OVER () AS weight,
         ceil(tokens * pow(most / tokens, 1 - alpha) - 1e-6)::BIGINT AS budget
  FROM sizes, all_of, alpha),
each AS (
  SELECT r.*, k.tokens, k.n, k.weight, k.budget, unnest(range(greatest(1, ceil(k.budget / k.tokens)::BIGINT))) AS epoch
  FROM rows_ r JOIN known k USING (key)),
hashed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '/' || epoch || '/{SEED}') AS h FROM each),
blocked AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n // {BLOCK_ROWS} + 1) AS block FROM hashed),
placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY key, epoch ORDER BY block, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM blocked)
SELECT doc_id, source, epoch::INTEGER AS epoch, block::BIGINT AS block, position::BIGINT AS position, n_tokens, round(weight, 9) AS weight
FROM placed WHERE position < budget
"""

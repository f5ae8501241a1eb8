"""Spelling variants: words of a corpus that are one insertion, deletion or replacement apart.

A single error lies in one half of a word, so the other half stands unchanged in its neighbour.
Words are dealt out by the half that must match: its first half for a forward minimal acyclic
automaton, its last half for a backward one, over reversed words. In either, the half is
followed exactly and the rest completed with one error; the number that the path through the
automaton adds up to (a perfect hash: the word's place in sorted order) is where its count
stands. What the forward search has found already (a neighbour with the same first half) the
backward one leaves out, so that no pair counts twice.

No automaton holds more than about ``BLOCK`` words. A half that more words share is dealt to
several automata, each of a part of them, and its queries go to all; queries stream past
an automaton in batches. All that leaves a task is a line for a query with neighbours.

Odd input: a null text has no words; a null doc_id has no checksum, so its runs stay as they
are; rows that repeat a doc_id count each; an empty table has no words; a run may have any
length; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: A run whose checksum this divides loses a letter.
DROP_EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent.
TIMES = 5
#: Words of one automaton.
BLOCK = 20_000


def observed(documents: DataFrame) -> DataFrame:
    """word: every run of letters of every text, in small letters, with a letter lost where its checksum says so."""
    runs = documents.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % DROP_EVERY == 0, short).otherwise(F.col("run")).alias("word"))


def words(documents: DataFrame) -> DataFrame:
    """word, n: the words that are long and frequent enough; counted in tasks first."""
    found = observed(documents).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """Minimal acyclic automaton of sorted words that numbers them in their order.

    ``edges`` of a state map a letter to the next state and to how many words of the state come before those.
    """

    def __init__(self, ordered: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        sizes, path, last = [0], [], ""
        for word in ordered:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, same, sizes)
            state = path[-1][2] if path else 0
            for letter in word[same:]:
                self.edges.append({})
                self.final.append(False)
                sizes.append(0)
                path.append((state, letter, len(self.edges) - 1))
                state = len(self.edges) - 1
            self.final[state] = True
            last = word
        self._close(path, 0, sizes)
        self._count(0, sizes)
        del self._known

    def _count(self, state: int, sizes: list[int]) -> None:
        before = int(self.final[state])
        for letter, (to, _) in self.edges[state].items():
            self.edges[state][letter] = (to, before)
            before += sizes[to]
        sizes[state] = before

    def _close(self, path: list[tuple[int, str, int]], keep: int, sizes: list[int]) -> None:
        """States beyond the first ``keep`` letters get no more words: equal ones become one."""
        while len(path) > keep:
            parent, letter, child = path.pop()
            self._count(child, sizes)
            known = self._known.setdefault((self.final[child], tuple(self.edges[child].items())), child)
            if known != child:  # the last state made, as all after it have gone
                self.edges.pop()
                self.final.pop()
                sizes.pop()
            self.edges[parent][letter] = (known, 0)

    def follow(self, text: str, start: int = 0, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """State and number after the letters of ``text`` from ``start``; None where there is no such path."""
        edges = self.edges
        for k in range(start, len(text)):
            step = edges[state].get(text[k])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, half: str, rest: str) -> Iterator[int]:
        """Numbers of the words that begin with ``half`` and go on with ``rest`` but for exactly one error.

        Of the errors that give the same word, the last in a run of equal letters is taken, so each comes once.
        """
        at = self.follow(half)
        if at is None:
            return
        state, number = at
        for k in range(len(rest) + 1):
            letter = rest[k] if k < len(rest) else ""
            ends = []
            if letter and rest[k + 1 : k + 2] != letter:
                ends.append(self.follow(rest, k + 1, state, number))  # the letter is missing
            for other, (to, before) in self.edges[state].items():
                if other != letter:
                    ends.append(self.follow(rest, k, to, number + before))  # one more letter
                    if letter:
                        ends.append(self.follow(rest, k + 1, to, number + before))  # another one
            for end in ends:
                if end is not None and self.final[end[0]]:
                    yield end[1]
            step = self.edges[state].get(letter)
            if step is None:
                return
            state, number = step[0], number + step[1]


class Block:
    """The words of one group in both automata, with their counts by number."""

    def __init__(self, forward: dict[str, int], backward: dict[str, int]):
        self.ahead = sorted(forward)
        self.behind = sorted(w[::-1] for w in backward)
        self.n_ahead = [forward[w] for w in self.ahead]
        self.n_behind = [backward[w[::-1]] for w in self.behind]
        self.forward, self.backward = Automaton(self.ahead), Automaton(self.behind)

    def near(self, word: str, ahead: bool) -> list[tuple[int, str]]:
        """(count, word) of the neighbours that share the first half; or the last, and not the first."""
        cut = len(word) // 2
        if ahead:
            return [(self.n_ahead[i], self.ahead[i]) for i in self.forward.one_error(word[:cut], word[cut:])]
        found = ((self.n_behind[i], self.behind[i][::-1]) for i in self.backward.one_error(word[cut:][::-1], word[:cut][::-1]))
        return [(n, w) for n, w in found if not w.startswith(word[:cut])]


_FOUND = "word string, n_near long, form_n long, form string"


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of group and role: a group's words (role 0) fill its automata, its queries (1) stream past."""
    group, held, block = None, ({}, {}), None
    for frame in frames:
        out = []
        for of, role, ahead, word, n in zip(frame["group"], frame["role"], frame["ahead"], frame["word"], frame["n"], strict=True):
            if of != group:
                group, held, block = of, ({}, {}), None
            if role == 0:
                held[0 if ahead else 1][word] = n
                continue
            block = block or Block(*held)
            near = block.near(word, ahead)
            if near:
                most, best = min((-k, w) for k, w in near)
                out.append((word, len(near), -most, best))
        if out:
            yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def _halves(of: Column, lengths: list[Column], ahead: bool) -> Column:
    """(ahead, half) for each of the lengths, which may repeat."""
    cut = (lambda k: F.substring(of, F.lit(1), k)) if ahead else (lambda k: F.substring(of, F.length(of) - k + 1, k))
    return F.transform(F.array_distinct(F.array(*lengths)), lambda k: F.struct(F.lit(ahead).alias("ahead"), cut(k).alias("half")))


def neighbours(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form (its most frequent neighbour) of every word of ``counted`` (word, n) that has a neighbour.

    A word of length m is met by queries of m - 1 to m + 1 letters, whose halves have two
    lengths; so it stands under two first and two last halves.
    """
    w, m = F.col("word"), F.length("word")
    half = lambda k: F.floor(k / 2).cast("int")
    held = F.concat(_halves(w, [half(m - 1), half(m), half(m + 1)], True), _halves(w, [half(m), half(m + 1), half(m + 2)], False))
    asked = F.concat(_halves(w, [half(m)], True), _halves(w, [half(m + 1)], False))
    dealt = lambda what, role: counted.select("word", "n", F.lit(role).alias("role"), F.explode(what).alias("h")).select("word", "n", "role", "h.ahead", "h.half")
    entries = dealt(held, 0)
    common = entries.groupBy("ahead", "half").agg(F.count("*").alias("size")).where(F.col("size") > block)  # an entry in ``block`` at most
    groups = max(1, ceil(4 * counted.count() / block))
    rows = entries.union(dealt(asked, 1)).join(common, ["ahead", "half"], "left")
    parts = F.ceil(F.col("size") / block).cast("int")
    part = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = rows.withColumn("part", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(part)))
    shared = F.pmod(F.xxhash64("ahead", "half"), F.lit(groups)).cast("string")
    own = F.concat_ws(" ", F.lit("half"), F.col("part").cast("string"), F.col("ahead").cast("string"), F.col("half"))
    rows = rows.withColumn("group", F.when(F.col("size").isNull(), shared).otherwise(own))
    found = rows.select("group", "role", "ahead", "word", "n").repartition(groups, "group").sortWithinPartitions("group", "role").mapInPandas(_search, _FOUND)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from a word ends. Counts grow at each step, so there is an end; each round doubles the steps."""
    now = materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").take(1):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        later = now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        now, gone = materialize(later), now
        release(gone)
    return now.select("word", "root")


def group_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = materialize(words(documents))
    joined = counted.join(neighbours(counted), "word", "left")
    formed = F.col("form_n") >= TIMES * F.col("n")
    found = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    out = found.join(_roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE crc(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS l FROM crc WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
u AS (SELECT doc_id, r, count(*) AS c, hex(encode(doc_id || ':' || r)) AS x FROM runs GROUP BY doc_id, r),
h AS (SELECT r, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]))) AS h FROM u, tab),
o AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word),
f AS (SELECT best.word, n_near, most, min(other) AS other FROM best JOIN pairs ON best.word = pairs.word AND pairs.n = most GROUP BY best.word, n_near, most),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN other END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
chain(word, stop) AS (SELECT word, word FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.stop = formed.word WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, c.stop AS root, formed.n, formed.n_near, formed.form_n FROM formed JOIN (SELECT chain.word, chain.stop FROM chain JOIN formed e ON chain.stop = e.word WHERE e.form IS NULL) c ON formed.word = c.word
"""

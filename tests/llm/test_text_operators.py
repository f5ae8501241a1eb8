"""Operators on documents against brute force, and the defined results of odd input."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from stressframe.llm import language_id, license_scan, mixing, near_dedup, packing, quality_rules, queries, substring_dedup
from tests_llm_helpers import brute_classes, brute_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, `key` string, weight double, digest string, class_id int"
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Null and empty values, repeated rows, ties, a very long text, odd characters."""
    long = prose(30_000, 1)
    base = prose(120, 2)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, base, "en", "a"), (5, base, "en", "b"), (6, " ".join(near), None, "b"), (7, long, "de", "b"), (8, "日本語 \U0001d518 é " * 30, "ja", "c"), (9, "one two", "en", "c"), (None, "no id but text", "en", None), (10, "x", "en", "c"), (10, "x", "en", "c"), (11, prose(200, 9), "en", "c"), (12, "!!! ### 123", "en", "c")]
    return [(i, t, g, s, len(t or ""), "k", "q", 0.5, "d", 3) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("often", [20_000, 3])
def test_repeated_passages_match_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(substring_dedup, "OFTEN", often)
    rng = random.Random(3)
    base = "".join(rng.choice("abé") for _ in range(300))
    rows = [(1, "a" * 50), (2, None), (3, ""), (4, "ab" * 30), (5, "a" * 50), (None, "qé" * 20), (7, "q" + "é" * 40), (7, "other")]
    rows += [(10 + i, base[rng.randint(0, 100) : rng.randint(150, 300)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, substring_dedup.measure(df, 20).collect()))) == sorted(map(str, brute_windows(rows, 20)))


def test_passages_on_odd_input(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is null or doc_id != 7").collect()]
    got = [tuple(r) for r in substring_dedup.measure(odd.where("doc_id is null or doc_id != 7"), 200).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_windows(rows, 200)))
    assert substring_dedup.measure(empty).count() == 0
    cut = substring_dedup.remove(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[4] == ""


def test_passages_of_very_long_texts(spark, odd):
    """A text of 30,000 words that holds a passage of its own twice, beside another that shares one."""
    long, shared = prose(30_000, 1), prose(60, 71)
    rows = [(7, f"{long} {shared} {prose(50, 72)} {shared}"), (8, f"{prose(40, 73)} {shared} {prose(40, 74)}"), (9, prose(200, 75))]
    got = [tuple(r) for r in substring_dedup.measure(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_windows(rows, 200)))


@pytest.mark.parametrize("hot", [1 / 1000, 0.01, 2.0])
def test_copies_in_a_third_of_all_rows(spark, monkeypatch, hot):
    """Hot keys are joined apart; with a limit over 1 none is."""
    from stressframe.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    rows = [(k, prose(50, 81) if k % 3 == 0 else prose(50, 1000 + k)) for k in range(150)] + [(200, None), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, substring_dedup.measure(df, 100).collect()))) == sorted(map(str, brute_windows(rows, 100)))
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.deduplicate(df).collect()} == brute_classes(rows)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove(df, 100).collect()}
    assert cut[0] == cut[3] == "" and cut[1] == rows[1][1] and cut[200] is None


def test_near_duplicates_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for g in range(40):
        text = prose(rng.choice([5, 8, 20, 60, 150, 400]), 100 + g).split()
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(text)))
            text = text[:]
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = f"edit{rng.randint(0, 10**6)}"
    shared = prose(60, 77)
    rows += [(len(rows) + i, shared + " " + prose(80, 500 + i)) for i in range(30)]  # a passage alone makes no near copy
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_large_groups_of_near_copies_are_one_class(spark):
    base, rows = prose(200, 5).split(), []
    for i in range(150):
        text = base[:]
        text[(7 * i) % 200] = f"w{i}"
        rows.append((i, " ".join(text)))
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_pairs_hidden_in_a_large_family_of_one_template(spark):
    template, rows = prose(180, 8), []
    for i in range(240):  # any two at 0.786, of the first 160 each two in a row at 0.802
        pair = f"p{i // 2} q{i // 2}" if i < 160 else f"p{i}x q{i}x"
        rows.append((i, " ".join([template, pair, *(f"u{i}n{k}" for k in range(22))])))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < 160 else i for i in range(240)}


def test_near_duplicates_on_odd_input(odd, empty):
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.deduplicate(odd).collect()), key=str)
    assert len(got) == odd.count()
    by = {d: (c, k) for d, c, k in got}
    assert by[1] == (1, True) and by[2] == (2, True) and by[3] == (3, True)
    assert by[4] == (4, True) and by[5] == (4, False) and by[6][0] == 4 and by[None] == (None, True)
    assert near_dedup.deduplicate(empty).count() == 0
    kept = near_dedup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12]))


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(0, 6, rng.integers(0, 20))
        assert near_dedup.aligned(a, b, 100) == lcs(a.tolist(), b.tolist())


def test_banded_alignment_by_either_way():
    rng = np.random.default_rng(4)

    def banded(a, b, band):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = max(t[i, j] + (x == y and abs(i - j) <= band), t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 30))
        band = int(rng.integers(0, 12))
        order = np.argsort(b, kind="stable")
        left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
        assert near_dedup._by_bits(order, left, right, len(b), band) == near_dedup._chained(order, left, right, len(b), band) == banded(a, b, band)
    a = rng.integers(0, 2, 3000)  # shingles with many places
    b = np.delete(a, rng.integers(0, 3000, 40))
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    assert near_dedup._by_bits(order, left, right, len(b), 50) == near_dedup._chained(order, left, right, len(b), 50)


def test_alignment_of_long_repetitive_texts_is_quick():
    one, other = near_dedup.shingles("word " * 20_000), near_dedup.shingles("word " * 9_000 + "other " + "word " * 9_999)
    began = time.process_time()
    assert near_dedup.similarity(one, other) > 0.8
    assert time.process_time() - began < 3


def class_of(spark, rows, partitions):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {}
    for r in near_dedup.deduplicate(df).collect():
        assert got.setdefault(r["doc_id"], (r["class_id"], r["kept"])) == (r["class_id"], r["kept"])
    return got


def test_repeated_ids_of_different_texts(spark):
    """A document of several texts joins their classes, the same in every run and partitioning."""
    one, other = prose(120, 51).split(), prose(120, 52).split()
    rows = [(5, " ".join(one)), (5, " ".join(other)), (1, " ".join([*one[:60], "changed", *one[61:]])), (9, " ".join([*other[:30], "changed", *other[31:]])), (7, None), (7, " ".join(one)), (8, prose(120, 53)), (5, " ".join(one)), (3, prose(50, 54)), (3, "  ")]
    want = {5: (1, False), 1: (1, True), 9: (1, False), 7: (1, False), 8: (8, True), 3: (3, True)}
    assert all(class_of(spark, rows, n) == want for n in (1, 3, 7))


@pytest.mark.parametrize("block", [256, 8])
def test_several_classes_in_large_buckets(spark, monkeypatch, block):
    """Families on one shared text, large and small, against brute force; classes get blocks of their own or share some."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, template, rows = random.Random(9), prose(150, 61), []
    for g in range(12):
        own = prose(38, 300 + g).split()
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = own[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), template + " " + " ".join(text)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def repeated_brute(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    return len(marked)


def test_quality_counts(spark, odd, empty):
    rng = random.Random(6)
    texts = [None, "", "a b\nc d\na b\n\n \n", "x " * 40, "é# $ %\x85& |<>\xa0*", prose(500, 3), prose(30, 4) + " " + prose(30, 4)] + [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality_rules.judge(df).collect():
        t = texts[r["doc_id"]] or ""
        words = t.encode().split()
        lines = t.split("\n")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
        assert r["n_repeat_words"] == repeated_brute(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    judged = quality_rules.judge(odd)
    assert judged.count() == odd.count() and quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and quality_rules.keep(empty).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged.where("kept").collect())


def test_distance_is_jensen_shannon():
    p, q = np.array([[1, 0, 3], [5, 5, 0], [0, 0, 0]]), np.array([[1, 0, 3], [0, 0, 7], [1, 1, 1]])
    assert np.allclose(quality_rules.distances(p, q), [0, 1, 0])


def test_quality_rejects_other_distributions(spark):
    rows = [(i, prose(200, i), "en") for i in range(60)] + [(100, prose(200, 99).upper().replace(" ", "!! "), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[100] and all(kept[i] for i in range(60))


def test_quality_of_rare_unknown_and_many_languages(spark):
    def of(lang, seed, n=120):
        rng = random.Random(seed)
        return " ".join(rng.choice(quality_rules.COMMON_WORDS[lang]) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))

    rows = [(i, of("en", i), "en") for i in range(100)]
    rows += [(1000 + i, of("de", 1000 + i), "de") for i in range(19)]  # too few for a reference
    rows += [(2000 + i, of("fr", 2000 + i), "fr") for i in range(20)]
    rows += [(3000 + i, of("fr", 3000 + i), None) for i in range(5)]
    rows += [(4000, of("en", 4000).upper().replace(" ", "!! "), None)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, r in judged.items() if not r["kept"]] == [4000]
    assert all(judged[1000 + i]["word_distance"] is None or np.isnan(judged[1000 + i]["word_distance"]) for i in range(19))
    many = [(f"l{k}", [1] * len(quality_rules.CHARACTER_CLASSES), [1] * (len(quality_rules.WORD_BINS) + 1), False) for k in range(300) for _ in range(20)]
    assert quality_rules.references(spark.createDataFrame(many, "__lang string, characters array<long>, words array<long>, base_failed boolean")).count() == 300


def js(p, q):
    def share(x):
        return [v / sum(x) for v in x]

    p, q = share(p), share(q)
    return max(0.0, sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)) ** 0.5 / 2**0.5


def brute_verdicts(rows):
    """doc_id -> kept, in plain Python: references, medians and limits anew."""
    m = {i: quality_rules.measure(t) for i, t, _ in rows}
    failed = {i: x[0] < 20 or 100 * x[4] > 30 * x[0] for i, x in m.items()}
    langs = {g for _, _, g in rows if g is not None and sum(h == g and not failed[i] for i, _, h in rows) >= quality_rules.MIN_REFERENCE_TEXTS}
    sums = {g: [np.sum([m[i][k] for i, _, h in rows if h == g and not failed[i]], axis=0).tolist() for k in (5, 6)] for g in langs}
    far = {}
    for i, _, g in rows:
        against = [g] if g in langs else list(langs) if g is None else []
        far[i] = [min((js(m[i][5 + k].tolist(), sums[h][k]) for h in against), default=None) if m[i][5 + k].sum() >= least else None for k, least in ((0, quality_rules.MIN_CHARACTERS), (1, quality_rules.MIN_WORDS))]
    excess = {i: None if d[1] is None else d[1] * m[i][6].sum() ** 0.5 for i, d in far.items()}
    kept = {}
    for i, _, g in rows:
        tested = [round(excess[j], 2) for j, _, h in rows if excess[j] is not None and not failed[j] and (g is None or h == g)]
        middle = np.median(tested) if tested else 0
        limit = max(quality_rules.LEAST_LIMIT, middle + quality_rules.DEVIATIONS * np.median([round(abs(v - middle), 2) for v in tested])) if tested else 0
        kept[i] = not failed[i] and not (far[i][0] is not None and far[i][0] > quality_rules.MAX_CHARACTER_DISTANCE) and not (excess[i] is not None and excess[i] > limit)
    return kept


def test_quality_verdicts_match_brute_force(spark):
    """Planted word salad passes the characters and fails the words; clean texts of every length stay."""
    rng, rows = random.Random(17), []
    for lang in ("en", "de"):
        for _ in range(90):
            n = rng.choice([30, 60, 120, 300, 900])
            rows.append((len(rows), " ".join(rng.choice(quality_rules.COMMON_WORDS[lang]) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n)), lang))
    salad = len(rows)
    rows += [(salad + k, prose(300, 800 + k), "en") for k in range(6)]  # no common word
    rows += [(len(rows) + k, prose(100, 900 + k), g) for k, g in enumerate((None, None, "xx", "de"))] + [(len(rows) + 5, None, "en"), (len(rows) + 6, "a " * 50, "en")]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i: r["kept"] for i, r in judged.items()} == brute_verdicts(rows)
    assert all(judged[i]["kept"] for i in range(salad)) and all(not judged[salad + k]["kept"] and judged[salad + k]["character_distance"] <= quality_rules.MAX_CHARACTER_DISTANCE for k in range(6))


def test_languages_are_told_apart(spark, sf):
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_kernel_is_normalised_overlap():
    texts = ["abc abd", "abd xyz", "zzz"]
    model = language_id.fit(texts, ["p", "q", "q"], orders=2, per_label=2)

    def held(t):
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)}

    k = model.kernels(texts)
    marks = ["abc abd", "abd xyz", "zzz"]
    want = [[len(held(a) & held(b)) / np.sqrt(len(held(a)) * len(held(b))) for b in marks] for a in texts]
    assert np.allclose(k, want, atol=1e-6)


def test_kernel_counts_unknown_grams_in_the_norm():
    marks = ["abc abd", "abd xyz", "zzz"]
    model = language_id.fit(marks, ["p", "q", "q"], orders=3, per_label=2)
    texts = ["abc qqq www rrr ttt uuu", "日本語 abc 本語本 𝔘x", "zzz", "no such letters here", *(prose(40, k) for k in range(5)), "abd"]

    def held(t):
        t = f" {t} "
        t = "".join(c if c.isalpha() else " " for c in t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    want = [[len(held(a) & held(b)) / np.sqrt(len(held(a)) * len(held(b))) for b in marks] for a in texts]
    assert np.allclose(model.kernels(texts), want, atol=1e-6)
    for size in (100, 7):  # whatever the pieces
        saved, language_id.grams.__defaults__ = language_id.grams.__defaults__, (size,)
        try:
            assert np.allclose(model.kernels(texts), want, atol=1e-6)
        finally:
            language_id.grams.__defaults__ = saved


def test_training_sample_takes_equal_texts_once(spark):
    rows = [("copied text of one language", "en")] * 500 + [(f"text number {'x' * k} of many", "en") for k in range(40)]
    got = language_id.training_sample(spark.createDataFrame(rows, "text string, lang string"), per_label=30).collect()
    assert len(got) == 30 and len({r["text"] for r in got}) == 30


def test_language_columns_that_clash(spark):
    df = spark.createDataFrame([(1, prose(50, 1), "q", 7)], "doc_id long, text string, lang_pred string, score int")
    model = language_id.fit([prose(50, 1), "日本語です"], ["en", "ja"])
    got = language_id.identify(df, model, ["doc_id", "lang_pred", "score"]).collect()[0]
    assert got["lang_pred"] == "en" and 0 <= got["score"] <= 1


def test_language_on_odd_input(odd, empty):
    model = language_id.fit([prose(50, 1), "日本語です"], ["en", "ja"])
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 12)) and got[4]["lang_pred"] == "en" and got[8]["lang_pred"] == "ja"
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_whole_texts_count_whatever_the_pieces():
    model = language_id.fit([prose(100, 1), prose(100, 2)], ["a", "b"])
    text = prose(3000, 5)
    whole = model.kernels([text])
    saved, language_id.grams.__defaults__ = language_id.grams.__defaults__, (100,)
    try:
        assert np.allclose(model.kernels([text]), whole)
    finally:
        language_id.grams.__defaults__ = saved


@pytest.fixture(scope="module")
def words():
    return packing.tokenizer(queries.tokenizer_path())


def test_ids_are_those_of_the_tokenizer(words, sf, spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_path())
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", "\n", " a", "a  b", "x\n\ny", "hi<|endoftext|>yo", " don't I'll\nfoo's 123 4", "日本 語　x", "a \n b", "tail ", "é 𝔘 ok\u2003z", "a\tb\xa0c"]
    assert all(list(got) == known.encode(t, add_special_tokens=False).ids for got, t in zip(words.many(texts), texts))


def test_packing(spark, odd, empty, words):
    got = [r.asDict() for r in packing.pack(odd, queries.tokenizer_path(), 64).collect()]
    ids = {i: [list(map(int, x)) + [2] for x in words.many([t or ""])] for i, t in ((r["doc_id"], r["text"]) for r in odd.collect())}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(r["length"] for r in got) == sum(len(ids[r["doc_id"]][0]) for r in odd.collect())
    assert packing.pack(empty, queries.tokenizer_path(), 64).count() == 0


def test_plans_are_whole_and_tight():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([8, 16, 50, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 20))}
        plan = packing.make_plan(counts, capacity)
        place, ranks = {}, {}
        for n, rank, k, first, offset in plan.rows:
            ranks.setdefault(n, []).append((rank, k))
            for i in range(k):
                place.setdefault(first + i, []).append((offset, n))
        for n, runs in ranks.items():
            assert sum(k for _, k in runs) == counts[n] and all(a + k == b for (a, k), (b, _) in zip(sorted(runs), sorted(runs)[1:]))
        assert set(ranks) == set(counts) and len(place) == plan.sequences
        for row in place.values():
            at = 0
            for offset, n in sorted(row):
                assert offset == at
                at += n
            assert at <= capacity
    counts = {n: rng.randint(1, 400) for n in range(1, 1025)}
    assert packing.make_plan(counts, 1024).sequences <= 1.01 * sum(n * k for n, k in counts.items()) / 1024


def test_pieces():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_mixing_keeps_documents_and_the_limit(spark, odd, empty):
    rows = [(i, "word " * (5 + i % 7), "en", "big" if i % 3 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.realise(df, max_repeats=1.5).toPandas()
    assert set(got.doc_id) == set(range(3000))
    tokens = mixing.token_estimate(F.col("text"))
    size = {r["source"]: r["t"] for r in df.groupBy("source").agg(F.sum(tokens).alias("t")).collect()}
    share = got.groupby("source").n_tokens.sum()
    assert all(share[s] <= 1.5 * size[s] + 20 for s in size)
    weight = got.groupby("source").weight.first()
    assert np.allclose((share / share.sum()).sort_index(), weight.sort_index(), atol=0.01)
    mixed = mixing.mix(df, max_repeats=1.5)
    assert mixed.columns == df.columns and mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == got.groupby("doc_id").size().to_dict()
    assert mixing.realise(empty).count() == 0 and mixing.mix(empty).count() == 0
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()} and out.count() >= odd.count()


@pytest.mark.parametrize("budget", [None, 5000])
def test_mixing_of_many_sources_is_the_same(spark, monkeypatch, budget):
    """Rounds of aggregations find the exponent that one row of all sources gives."""
    rows = [(i, "w" * (4 * (1 + i % 13)), f"s{i % (3 + i % 29)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.realise(df, 0.95, 1.6, budget).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.realise(df, 0.95, 1.6, budget).collect())) == want


def test_packing_of_the_table_is_tight(spark, sf):
    got = queries.op3_best_fit_packing(spark, sf).select("sequence_id", "length").toPandas()
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 1


def test_mixing_meets_entropy_with_a_budget(spark):
    rows = [(i, "w" * 40, "a" if i % 10 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.realise(df, entropy_share=0.9, max_repeats=10.0, budget=4000).toPandas()
    w = got.groupby("source").weight.first().to_numpy()
    assert abs(-(w * np.log(w)).sum() / np.log(2) - 0.9) < 1e-6
    assert abs(got.n_tokens.sum() - 4000) <= 20


def test_license_scan(spark, odd, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c.py", prose(50, 1)), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(50, 2)), (4, "x/y.py", prose(50, 3)), (5, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "a/z/q/r.py", None), (7, None, "nothing"), (8, "top.py", "")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_directory"]) for r in license_scan.scan(df, F.col("path")).collect()}
    assert got[1][:2] == ("MIT", "own") and got[2] == ("GPL-3.0", "inherited", "a/b") and got[3][:2] == ("Apache-2.0", "own")
    assert got[4] == (None, None, None) and got[6] == ("MIT", "inherited", "a") and got[7] == (None, None, None) and got[8] == (None, None, None)
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert license_scan.scan(odd, path).count() == odd.count() and license_scan.scan(empty, path).count() == 0


def test_wrapped_license_headers_above_code():
    headers = {
        "MIT": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "ISC": "// Permission to use, copy, modify, and/or\n// distribute this software for any purpose\n// with or without fee\n// is hereby granted",
        "Unlicense": "This is free and unencumbered software released into the public\ndomain.",
    }
    m = license_scan.Matcher()
    for name, header in headers.items():
        for above in ("", prose(60, 6) + "\n"):
            score, found, whole = m.scan(f"{above}{header}\n\n{prose(200, 7)}\n")
            assert found == name and score >= license_scan.LEAST and whole < license_scan.LEAST, (name, score, found)
    assert m.scan("# no licence\n" + prose(300, 8))[0] < license_scan.LEAST


def brute_licences(texts):
    """Best cosine with each template over the whole text and every window of lines, from plain dictionaries; common words are no terms."""
    templates = [Counter(w for w in license_scan.WORD.findall(t.lower()) if w not in license_scan.COMMON) for _, t in license_scan.TEMPLATES]
    number = {w: sum(w in c for c in templates) for c in templates for w in c}

    def vector(counts):
        v = {w: n * (math.log((1 + len(templates)) / (1 + number.get(w, 0))) + 1) for w, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    known = [vector(c) for c in templates]
    span = license_scan.SPAN * max(sum(c.values()) for c in templates)
    for text in texts:
        lines = [[w for w in license_scan.WORD.findall(x) if w not in license_scan.COMMON] for x in text.lower().split("\n")]
        best = [0.0] * len(known)
        windows = [lines] + [lines[i:j] for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if j == i + 1 or sum(map(len, lines[i:j])) <= span]
        for window in windows:
            v = vector(Counter(w for x in window for w in x))
            for k, t in enumerate(known):
                best[k] = max(best[k], sum(x * t.get(w, 0) for w, x in v.items()))
        yield best


BSD_2 = f"Copyright (c) 2020, Somebody. All rights reserved.\n\n{license_scan.BSD_OPENING}:\n\n1. {license_scan.BSD_TWO}\n\n{license_scan.BSD_DISCLAIMER}"
BSD_3 = BSD_2.replace("\n\nTHIS", f"\n3. {license_scan.BSD_THIRD}\n\nTHIS")


def test_license_windows_match_brute_force():
    rng = random.Random(23)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.WORD.findall(t.lower())})
    texts = [BSD_2, BSD_3, "", prose(60, 3)]
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 14)):
            template = rng.choice(license_scan.TEMPLATES)[1].split()
            at = rng.randrange(len(template))
            lines.append(" ".join(rng.choice([template[at : at + rng.randint(1, 30)], [rng.choice(words) for _ in range(5)], prose(6, rng.random()).split()])))
        texts.append("\n".join(lines))
    m = license_scan.Matcher()
    for text, want in zip(texts, brute_licences(texts)):
        score, name, _ = m.scan(text)
        assert (name is None) == (m.decide(want)[1] is None) and name == m.decide(want)[1] and score == pytest.approx(m.decide(want)[0])


def test_licences_that_begin_alike_and_mentions():
    m = license_scan.Matcher()
    assert m.scan(BSD_2)[1] == "BSD-2-Clause" and m.scan(BSD_3)[1] == "BSD-3-Clause"
    assert m.scan(prose(40, 1) + "\n" + BSD_2)[1] == "BSD-2-Clause" and m.scan(license_scan.BSD_OPENING)[1] == "BSD-2-Clause OR BSD-3-Clause"
    assert m.scan("this is a discussion of the mit license and released software under the license")[1] is None
    assert m.scan("Either version 2 or the MIT license may be the one that people discuss here.")[1] is None
    assert m.scan(dict(license_scan.TEMPLATES)["GPL-2.0"])[1] == "GPL-2.0" and m.scan(dict(license_scan.TEMPLATES)["GPL-3.0"])[1] == "GPL-3.0"


def test_licences_are_inherited_as_by_hand(spark):
    rng = random.Random(31)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    notes = ["Released under the MIT License", "Licensed under the Apache License, Version 2.0"]
    rows = [(k, "/".join(x for x in (rng.choice(folders), rng.choice([f"f{k}.py", f"f{k}.py", "LICENSE", "COPYING.txt"])) if x), rng.choice([prose(20, k), prose(20, k), rng.choice(notes), prose(30, k) + "\n" + rng.choice(notes)])) for k in range(80)]
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_directory"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    m = license_scan.Matcher()
    own = {k: m.scan(t) for k, _, t in rows}
    holders = {}
    for k, path, _ in rows:
        score, name, whole = own[k]
        base = path.rsplit("/", 1)[-1]
        if name and (whole >= license_scan.FILE_LEAST or base in ("LICENSE", "COPYING.txt")):
            holders.setdefault(path.rpartition("/")[0], []).append((score, name))
    for k, path, _ in rows:
        at, want = path.rpartition("/")[0], (own[k][1], "own", None)
        if own[k][1] is None:
            while at not in holders and at:
                at = at.rpartition("/")[0]
            want = (max(holders[at])[1], "inherited", at) if at in holders else (None, None, None)
        assert got[k] == want


def test_license_cosine():
    m = license_scan.Matcher()
    assert m.match("Released under the MIT License")[0] == pytest.approx(1) and m.match("")[1] is None

"""Web archives by round trips and damage; the filter audit and spelling variants against brute force."""

import gzip
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyarrow import fs as stores
from pyspark.sql import functions as F
from stressframe.llm import filter_audit, spelling, warc

LOCAL = stores.LocalFileSystem()
PAGES = "page_id long, url string, html string, digest string, last long, n int, payload string"


def page_rows():
    rng = random.Random(5)
    nested = warc.record_bytes({"page_id": 99, "url": "http://x/", "payload": b"inner", "payload_bytes": 5, "digest": warc.sha1_of(b"inner"), "record_type": "response", "refers_to": None}, "2026-01-01T00:00:00Z").decode()
    rows = [(1, "http://a.b/c d\r\nX: y", "<p>one</p>"), (2, None, None), (3, "", ""), (4, "http://a/é", "<p>one</p>"), (4, "http://a/é", "<p>one</p>"), (None, "http://n", "<p>one</p>"), (None, None, "alone"), (5, "http://z", nested * 3), (6, "http://w", "é日本\U0001d518" * 50_000), (-7, "http://m", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abcdefgh <>/") for _ in range(rng.randint(0, 3000)))) for i in range(40)]
    return [(*r, "d", 1, 2, "p") for r in rows]


def expected(rows, least=0):
    groups = {}
    for i, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html, *_ in rows:
        raw, ids = (html or "").encode(), groups[html or ""]
        last = max((x for x in ids if x is not None), default=None)
        again = last is not None and i != last and len(raw) >= least
        out.append((i, len(raw), warc.sha1_of(raw), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def seen(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize(("how", "span"), [("gzip", 1 << 26), ("none", 1 << 26), ("gzip", 500), ("none", 500)])
def test_archives_round_trip(spark, tmp_path, how, span):
    """Ranges that begin within records, and records that hold records, give the same as one range."""
    pages = spark.createDataFrame(page_rows(), PAGES)
    warc.write(warc.records(pages), f"file://{tmp_path}/a", compression=how, roll="4000")
    assert len(list((tmp_path / "a").glob("*.warc*"))) > 3 and not (tmp_path / "a/_temporary").exists()
    scanned = warc.scan(spark, f"file://{tmp_path}/a", True, span)
    found = warc.read(scanned)
    assert seen(found) == expected(page_rows())
    assert warc.gaps(scanned).count() == 0
    texts = Counter(bytes(r["payload"]).decode() for r in found.where("record_type = 'response'").collect())
    assert set(texts) == {r[2] or "" for r in page_rows()}


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    assert seen(warc.round_trip(pages, f"file://{tmp_path}/a", 11)) == expected(page_rows(), 11)
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_base32_by_functions(spark):
    rows = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("b"))
    assert all(r["d"] == warc.sha1_of(bytes(r["b"])) for r in rows.select("b", warc.base32_sha1(F.col("b")).alias("d")).collect())


def plain(i, payload, kind="response"):
    return warc.record_bytes({"page_id": i, "url": f"http://p/{i}", "payload": payload, "payload_bytes": len(payload), "digest": warc.sha1_of(payload), "record_type": kind, "refers_to": None}, "2026-01-01T00:00:00Z")


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("span", [1 << 26, 300])
def test_damage_is_passed_over_and_logged(spark, tmp_path, zipped, span):
    """Flipped bytes, garbage between records, a wrong length and a cut end: the other records are all there, and gaps cover the rest."""
    parts = [plain(i, f"payload {i} ".encode() * 20) for i in range(12)]
    parts = [gzip.compress(p, mtime=0) if zipped else p for p in parts]
    flipped = bytearray(parts[3])
    flipped[-30] ^= 0x55
    parts[3] = bytes(flipped)
    parts[5] += b"garbage \x1f\x8b\x08 WARC/1.1\r\n no record"
    parts[7] = parts[7][:-20] if zipped else parts[7].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 2)
    parts[11] = parts[11][:-9]
    name = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    name.write_bytes(b"".join(parts))
    scanned = warc.scan(spark, f"file://{tmp_path}", True, span)
    found = warc.read(scanned).collect()
    assert sorted(r["page_id"] for r in found) == [i for i in range(12) if i not in (3, 7, 11)]
    gaps = sorted((r["start"], r["end"]) for r in warc.gaps(scanned).collect())
    covered = sorted(gaps + [(r["start"], r["end"]) for r in found])
    assert covered[0][0] == 0 and covered[-1][1] == name.stat().st_size and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert sum(b - a for a, b in gaps) <= sum(len(parts[i]) for i in (3, 7, 11)) + 60
    assert all(r["reason"] for r in warc.gaps(scanned).collect())


def test_several_records_of_a_member_and_foreign_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info + plain(1, b"x") + plain(2, b"")))
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"no archive at all")
    scanned = warc.scan(spark, f"file://{tmp_path}")
    assert sorted(r["page_id"] for r in warc.read(scanned).collect()) == [1, 2]
    assert scanned.where("type = 'warcinfo'").count() == 1
    assert [(r["start"], r["end"]) for r in warc.gaps(scanned).collect()] == [(0, 17)]


# The filter audit

DOCS = "doc_id long, text string, source string, part string, mask int, n int, digest string"


def doc_rows():
    rng, rows = random.Random(8), []
    for i in range(120):
        words = ["".join(rng.choice("abAB#") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 150, 250]))]
        rows.append((i // 2 if i % 7 == 0 else i, rng.choice([" ".join(words), "same text", "low " * 300, "\v".join(["w%d" % k for k in range(300)])]), rng.choice(["a", "b", None, ""])))
    rows += [(None, "same text", "a"), (None, None, None), (500, None, "c"), (501, "", "c"), (502, "x\x1fy " * 210, "c")]
    return [(*r, "p", 1, 2, "d") for r in rows]


def audit_brute(rows, labels):
    said = {}
    for i, quality, toxic in labels:
        g, t = said.get(i, (0, 0))
        said[i] = (max(g, int(quality == 1)), max(t, int(toxic == 1)))
    first, docs = {}, []
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((source or "", {c for c in fails if fails[c]}, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                gone = [d for d in mine if c in d[1] and not d[1] & set(order[:k])]
                kept = sum(not d[1] & set(order[: k + 1]) for d in mine)
                shares[part, c] += len(gone)
                out[part, order, k + 1] = [kept, len(gone), sum(c in d[1] for d in mine) - len(gone), sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return sorted((part, order, k, *v, shares[part, order[k - 1]]) for (part, order, k), v in out.items())


def test_audit_matches_brute_force(spark):
    rows, labels = doc_rows(), [(i, i % 3 if i % 5 else None, i % 2) for i in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs, said = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, said).collect())
    assert got == audit_brute(rows, labels)
    assert filter_audit.audit(docs.limit(0), said).count() == 0
    assert filter_audit.audit(docs, said.limit(0)).count() == len(got)


def test_audit_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "Word " * 400_000, "a"), (2, "x" * 2_000_000, "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["mask"]) for r in filter_audit.masks(docs).collect()} == {(1, 6), (2, 1)}


def test_audit_runs_no_python(spark, sf):
    plan = filter_audit.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Spelling variants


def near_brute(counts):
    def one_error(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = [], {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_error(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 5 * n else None
        out.append([w, form[w], None, n, len(near), counts[form[w]] if form[w] else None])
    for row in out:
        row[2] = row[0]
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(str, map(tuple, out)))


def observed_brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("block", [20_000, 7])
def test_variants_match_brute_force(spark, monkeypatch, block):
    """Words over three letters, so that neighbours, runs and shared halves abound; small blocks deal halves to several automata."""
    rng = random.Random(11)
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (block,))
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randint(5, 9))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "a" * 40, "a" * 41, "ab" * 3000, "ab" * 3000 + "b"]
    rows = [(None if i % 50 == 0 else i // 2, " ".join(rng.choice(words).title() if k % 9 == 0 else words[min(int(rng.expovariate(0.03)), 155)] for k in range(60)) + ".x-y×z÷w") for i in range(150)]
    rows += [(7, " ".join(words[-2:])), (8, None), (9, "")] * 6
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    assert sorted(map(str, map(tuple, spelling.group_variants(df).collect()))) == near_brute(observed_brute(rows))
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"", "é" * 2000})
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.follow(w)
        assert automaton.final[state] and number == k
    languages = {}

    def language(state):
        if state not in languages:
            languages[state] = (automaton.final[state], frozenset((c, language(to)) for c, (to, _) in automaton.edges[state].items()))
        return languages[state]

    small = spelling.Automaton([w for w in words if len(w) < 9])
    automaton = small
    language(0)
    assert len(set(languages.values())) == len(languages) == len(small.edges)



"""URL filter: host and path rules first, a classifier for the rest.

The classifier is logistic regression on hashed character n-grams of host and path (kept
apart by a salt), fitted here on a small labelled table of URLs. The table pairs words that
are common in unwanted sites, and words of ordinary ones, with the shapes that URLs have on
the web at large: plain and nested hosts, national endings, ports, numbered addresses,
dated posts, product and document paths, user folders and queries. It is made by rule and
knows nothing of the pages to be judged.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
BITS = 14
ORDERS = (3, 4, 5)

#: Words of the labelled table.
BLOCKED_WORDS = (
    "casino poker slots roulette jackpot lottery betting bets gambling winner prize bonus viagra cialis pills pharmacy steroids diet porn xxx sex adult nude cams escort hookup dating "
    "loan payday credit debt cash bitcoin forex replica cheap discount deals free win warez crack keygen serial torrent downloads stream malware spam farm clicks popup ads adserver tracker banner backlinks seo followers likes phishing verify login-update giveaway miracle weightloss rich"
).split()
ALLOWED_WORDS = (
    "news weather library museum university school college science physics biology chemistry history geography music theatre garden recipes kitchen travel hotel museum gallery city council hospital clinic health children family sports football cycling railway station harbour bridge river mountain forest "
    "wiki docs manual reference tutorial guide forum blog journal review magazine archive research institute project software kernel compiler database engineering energy climate agriculture market bank insurance law court parliament government charity church community photo film books poetry language dictionary reading writing building training planning thinking teaching mother father brother teacher together another leather"
).split()
ENDINGS = "com net org info biz de fr es it nl pl co.uk ac.uk edu gov io eu com.br co.jp".split()
SYLLABLES = "an be co di er fo ga hi in jo ka le mi no or pa qu re so ta un ve wi za sch gra ton ber lin mar tel ous".split()


def labelled_urls(seed: int = 11) -> list[tuple[str, int]]:
    """The labelled table: (url, 1 to block), built by rule from the word lists; a third is to be blocked."""
    rng = random.Random(seed)

    def name() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))

    def host(words: list[str], label: int) -> str:
        other = rng.choice(words)
        first = rng.choice(words)
        body = rng.choice([f"{first}", f"{first}-{other}", f"{first}{other}", f"{name()}{first}", f"{first}{rng.randint(1, 999)}", f"{first}.{name()}", f"{name()}-{first}", f"the{first}"])
        if not label and rng.random() < 0.45:
            body = rng.choice([name(), f"{name()}-{name()}", f"{name()}.{name()}", f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"])
        return rng.choice(["", "", "www.", "m.", "blog.", "en.", "shop.", "static."]) + f"{body}.{rng.choice(ENDINGS)}" + (":8080" if rng.random() < 0.04 else "")

    def path(words: list[str], label: int) -> str:
        w, v = rng.choice(words), rng.choice(words)
        plain = ["", "/", f"/{rng.randint(1, 99999)}", f"/{rng.choice(['en', 'de', 'fr', 'it'])}/{rng.randint(1, 9999)}", f"/p/{name()}-{name()}", "/index.html", f"/{name()}/{name()}.html", f"/item?id={rng.randint(1, 9999)}"]
        own = [f"/{w}", f"/{w}/{v}.html", f"/{w}-{v}", f"/{rng.randint(1998, 2024)}/{rng.randint(1, 12):02d}/{w}-{name()}", f"/tag/{w}", f"/~{name()}/{w}.htm", f"/search?q={w}+{v}"]
        return rng.choice(plain if rng.random() < 0.6 else own)

    rows = []
    for k in range(3000):
        label = int(k % 3 == 0)
        words = BLOCKED_WORDS if label else ALLOWED_WORDS
        rows.append((f"{rng.choice(['http', 'https'])}://{host(words, label)}{path(words, label)}", label))
    return rows


def split(url: str | None) -> tuple[str, str]:
    """Host and path, as ``host_path`` has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    end_path = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:end_path]


_RNG = np.random.default_rng(19)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def hashed(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of each row's host and path, in order."""
    rows, slots = [], []
    for kind, texts in enumerate((hosts, paths)):
        raws = [f"^{t}$".encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        raw = _LETTERS[np.frombuffer(b"".join(raws), np.uint8)]
        row = np.repeat(np.arange(len(raws)), sizes)
        for n in ORDERS:
            if len(raw) >= n:
                code = np.full(len(raw) - n + 1, _SALTS[kind], np.uint64)
                for i in range(n):
                    code = _mixed(code + raw[i : len(raw) - n + 1 + i])
                inside = row[: len(code)] == row[n - 1 :]
                rows.append(row[: len(code)][inside])
                slots.append((code[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) << BITS | np.concatenate(slots))
    return both >> BITS, both & ((1 << BITS) - 1)


def _values(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What each n-gram of a row counts, so that rows have unit length."""
    unit = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    return unit, unit[row]


def fit(rows: Sequence[tuple[str, int]], l2: float = 1e-4, steps: int = 600, rate: float = 12.0) -> np.ndarray:
    """Weights of the slots, and the intercept last, by gradient descent on the regularised loss; the intercept starts at the table's prior."""
    parts = [split(url) for url, _ in rows]
    y = np.array([label for _, label in rows], float)
    row, flat = hashed([h for h, _ in parts], [p for _, p in parts])
    value = _values(row, len(y))[1]
    w, b = np.zeros(1 << BITS), float(np.log((1 + y.sum()) / (1 + (1 - y).sum())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[flat], len(y)) + b)))
        g = (p - y) / max(1, len(y))
        w -= rate * (np.bincount(flat, value * g[row], 1 << BITS) + l2 * w)
        b -= rate * float(g.sum())
    return np.append(w, b)


def probabilities(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Probability of each URL that it is to be blocked."""
    row, slot = hashed(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, _values(row, len(hosts))[1] * weights[slot], len(hosts)) + weights[-1])))


def probability(weights: np.ndarray, host: str, path: str) -> float:
    return float(probabilities(weights, [host], [path])[0])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where '://' is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the earlier one) and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Sequence[Rule], weights: np.ndarray, passed: Sequence[str] = ("page_id",), threshold: float = 0.5) -> DataFrame:
    """host, path, rule, verdict and the classifier's probability for every row of ``pages`` (url), in place of columns so called.

    A rule fits its host and all subdomains where the path starts with its own; the longest
    wins. Without one the verdict is the classifier's. Null or odd URLs have empty host and
    path and are classified so; repeated rows are judged alike, an empty table gives an
    empty one, and other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    passed = [c for c in passed if c not in ("host", "path", "rule", "verdict", "probability")]
    parts = pages.select(*passed, host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ready = parts.withColumns({"rule": rule, "verdict": verdict})
    held = pages.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = probabilities(held.value, list(frame["host"]), list(frame["path"]))
            frame["verdict"] = frame["verdict"].where(frame["verdict"].notna(), np.where(p >= threshold, "block", "allow"))
            yield frame.assign(probability=p)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema)
    return ready.mapInPandas(run, f"{schema}, probability double")

"""Brute-force versions that several tests use."""

import hashlib
from collections import Counter


def brute_windows(rows, length):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        for j in range(len(b) - length + 1):
            count[b[j : j + length]] += 1
    out = []
    for i, b in raws:
        mark = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                mark[j : j + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for j in range(len(mark)) if mark[j] and (j == 0 or not mark[j - 1]))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def word_shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_classes(rows):
    sets = [(i, set(word_shingles(t))) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                p, q = root(i), root(j)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}

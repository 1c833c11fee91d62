"""Plain-loop versions that the operators are tested against."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLACK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def union(pairs, nodes):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                g = windows.get(tuple(w[s : s + n]))
                if g:
                    hit.update(range(s, s + n))
                    found |= g
        names = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def simhash(text, k=3):
    w = [x.translate(LOWER) for x in BLACK.findall(text or "")]
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def near_groups(docs):
    prints = {d: simhash(t) for d, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = union(pairs, ids)
    return {d: (f"{prints[d]:016x}", roots[d]) for d in ids}


def base_quality(text):
    text = text or ""
    w = BLACK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLACK.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found = Counter(windows)
    covered = {j for i, x in enumerate(windows) if found[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def unigram(docs):
    tokens = lambda t: [x.translate(LOWER) for x in BLACK.findall(t or "")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for d, t in docs:
        if not held(d):
            counts.update(tokens(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = {}
    for d, t in docs:
        w = tokens(t)
        logs = [math.log10((c + 1) / (n + v + 1)) for c in [*(counts[x] for x in w), ends]]
        out[d] = (held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n, sum(logs))
    return out


def encoded(docs, path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for d, x in docs}


def alike(pairs, rows):
    """Those of the pairs whose texts have an edit similarity of 0.8 or more."""
    import duckdb
    import pandas as pd

    found = pd.DataFrame([(a, b, rows[a], rows[b]) for a, b in pairs], columns=["a", "b", "x", "y"])
    return duckdb.sql("SELECT a, b FROM found WHERE 5 * abs(length(x) - length(y)) <= greatest(length(x), length(y)) AND 5 * levenshtein(x, y) <= greatest(length(x), length(y))").fetchall()

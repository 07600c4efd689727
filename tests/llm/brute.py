"""Plain forms of the operators that tests hold queries and the pipeline against."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def contamination(docs, items):
    """(doc_id, words, hit words, items, digest of the items, any hit) of (id, text) rows."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit[k : k + n] = [1] * n
        names = sorted(str(x) for x in found if x is not None)
        yield (i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0)


def prints(texts, size=3):
    out = []
    for t in texts:
        w = SPACED.findall(low(t))
        shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def groups(n, linked):
    """The smallest index that each of n things is connected to by ``linked(i, j)``."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = find(a), find(b)
            if x != y and linked(a, b):
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def components(fingerprints, distance):
    return groups(len(fingerprints), lambda a, b: (fingerprints[a] ^ fingerprints[b]).bit_count() <= distance)


def shingles(t, size=5):
    w = SPACED.findall(low(t))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(texts, distance, similarity=0.8, size=5):
    """Groups of texts that share words' shingles, within a distance of their fingerprints; equal sequences of words always."""
    f, sets, words = prints(texts, size), [shingles(t, size) for t in texts], [SPACED.findall(low(t)) for t in texts]

    def linked(a, b):
        if words[a] == words[b]:
            return True
        both = len(sets[a] & sets[b])
        return (f[a] ^ f[b]).bit_count() <= distance and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9

    return groups(len(texts), linked)


def without_boilerplate(rows, sites, counts):
    """New texts of (id, text, site) rows: lines on so many sites stay in the document of the smallest id."""
    on, ids = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, s in rows:
        for line in t.split("\n") if t is not None else []:
            if counts(line):
                on[line].add(s)
                ids[line].add(i)
    many = {x for x in on if len(on[x] - {None}) >= sites}
    first = {x: min((i for i in ids[x] if i is not None), default=None) for x in many}
    return [None if t is None else "\n".join(x for x in t.split("\n") if not (x in many and first[x] != i)) for i, t, _ in rows]


def ratios(c):
    """The ratios of counts (name -> array), as ``statistics.ratios`` defines them."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    per_word = {"symbols_per_word": "n_symbols", "marks_per_word": "n_marks", "stops_per_word": "n_stops", "repeated_share": "n_repeat_words", "again_share": "n_again", "distinct_share": "n_distinct", "mean_word_length": "word_chars"}
    out = {k: c[v] / words for k, v in per_word.items()}
    out |= {"capital_share": c["n_upper"] / chars, "digit_share": c["n_digits"] / chars, "duplicate_line_share": c["n_dup_lines"] / np.maximum(c["n_lines"], 1), "words": c["n_words"].astype(float)}
    return out


def counts(t):
    """The five counts of the quality contract."""
    t = t or ""
    w, seen, dup = SPACED.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    five = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {x for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def resampled(docs, target, runs=1, buckets=10000, percent=10, least=20, seed=2024):
    """(id, features, weight, score, rank) of (id, text) rows; ranks of rows that tie in score and id are in no order."""

    def features(t):
        w = ALNUM.findall(low(t))
        return w, [" ".join(w[k : k + n]) for n in range(1, runs + 1) for k in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (collections.Counter(bucket(x) for text in texts for x in features(text)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1) * all_s / ((s[k] + 1) * all_t))) for k in range(buckets)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[-1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:-1]) for r in rows]


def negatives(rows, anchor=lambda i: i % 50 == 0, positives=5, count=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) of distinct (id, label, integers) rows, every anchor against every row."""
    rows, out = list(dict.fromkeys((i, l, tuple(v)) for i, l, v in rows)), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in rows:
        if a[0] is not None and anchor(a[0]):
            order = sorted(((-dot(a[2], r[2]), r[0] is None, r[0] or 0, r) for r in rows if r != a), key=lambda x: x[:3])
            for score, _, _, p in [x for x in order if x[3][1] == a[1]][:positives]:
                fit = [x for x in order if x[3][1] != a[1] and low * -score <= 100 * -x[0] <= high * -score]
                out += [(a[0], p[0], k, x[3][0], -score, -x[0]) for k, x in enumerate(fit[:count], 1)]
    return out

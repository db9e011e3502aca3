"""Plain-Python versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = (1 << 63) - 1


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rank(i):
    return LAST if i is None else i


def phrases(rows, width=20):
    words = [SPACE.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(least.get(k, LAST), rank(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone, seen = set(), set()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if least[k] < rank(i) or k in seen:
                gone |= set(range(p, p + width))
            seen.add(k)
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def suffixes(rows, width=50):
    data = [(t or "").encode() for _, t in rows]
    least = {}
    for (i, _), b in zip(rows, data):
        for p in range(len(b) - width + 1):
            k = b[p : p + width]
            least[k] = min(least.get(k, LAST), rank(i))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < rank(i):
                gone[p : p + width] = b"\x01" * width
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lines(rows, width=3):
    parts = [[] if t is None else t.split("\n") for _, t in rows]
    ink = lambda k: bool(SPACE.search("".join(k)))
    least = {}
    for (i, _), l in zip(rows, parts):
        for p in range(len(l) - width + 1):
            least[tuple(l[p : p + width])] = min(least.get(tuple(l[p : p + width]), LAST), rank(i))
    out = []
    for (i, t), l in zip(rows, parts):
        gone, seen = set(), set()
        for p in range(len(l) - width + 1):
            k = tuple(l[p : p + width])
            if ink(k) and (least[k] < rank(i) or k in seen):
                gone |= set(range(p, p + width))
            seen.add(k)
        out.append((i, len(l), len(gone), sha("\n".join(x for p, x in enumerate(l) if p not in gone))))
    return out


def base_rules(text):
    t = text or ""
    w, seen, dup = SPACE.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    count, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def contamination(rows, items, width=10):
    grams = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[p : p + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := grams.get(tuple(w[p : p + n]))):
                    hit |= set(range(p, p + n))
                    found |= k
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), bool(hit)))
    return out


def fingerprint(text):
    w = SPACE.findall(lower(text))
    shingles = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def linked(prints, distance=3):
    """Component of each distinct print, as its smallest member."""
    todo, label = sorted(prints), {}
    while todo:
        first, stack = todo[0], [todo[0]]
        while stack:
            at = stack.pop()
            if at in label:
                continue
            label[at] = first
            stack += [x for x in todo if x not in label and (x ^ at).bit_count() <= distance]
        todo = [x for x in todo if x not in label]
    return label

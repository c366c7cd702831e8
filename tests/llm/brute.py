"""Plain versions of the operators for small inputs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)] if words else [])


def components(rows, numerator=4, denominator=5, width=5):
    """Smallest id reachable, by id; rows of one id are one vertex."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and denominator * len(x & y) >= numerator * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def windows(items, width=10):
    out = {}
    for item, text in items:
        words = benchmark_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(tuple(words[i:i + width]), set()).add(item)
    return out


def benchmark_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, patterns):
    words, hit, items = benchmark_words(text), set(), set()
    for pattern, who in patterns.items():
        for i in range(len(words) - len(pattern) + 1):
            if tuple(words[i:i + len(pattern)]) == pattern:
                hit.update(range(i, i + len(pattern)))
                items |= who
    return len(words), len(hit), sorted(items)

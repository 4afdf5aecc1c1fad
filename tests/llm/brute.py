"""Plain reference versions of the operators, over Python lists."""

import hashlib
import re
from collections import defaultdict

SF = "/root/testdata/sf0.001"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z) if lower else text or "")


def shingles(text):
    w = space_words(text, lower=True)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows, percent=85):
    """doc_id -> smallest doc_id reachable over links of all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            shared = len(a & b)
            if shared and 100 * shared >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(A_TO_Z))


def contamination(text, items):
    """(n_words, n_hit, found item ids, contaminated)."""
    w, hit, found = bench_words(text), set(), set()
    for item_id, item in items:
        v = bench_words(item)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if v else []:
            for s in range(len(w) - n + 1):
                if w[s:s + n] == v[k:k + n]:
                    hit.update(range(s, s + n))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def kept_words(rows):
    """One (n_words, n_removed, sha256) for each (doc_id, text)."""
    least = defaultdict(list)
    words = [(i, space_words(t)) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 12):
            if i is not None:
                least[tuple(w[s:s + 13])].append(i)
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - 12) if i is not None and min(least[tuple(w[s:s + 13])]) < i for p in range(s, s + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m)]
    return [(BASE[k][0], s, e) for s, k, e in sorted(found)]

"""Brute-force versions of the operators, on rows (doc_id, text)."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def near_components(rows, size, percent=80):
    """doc_id -> (set size, component)."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(ascii_lower(t))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    both = collections.Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(rows, length=50):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in bodies:
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(d, first.get(g, d))
    out = {}
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def without_line_runs(rows, k):
    """doc_id -> text without later runs of k lines."""
    seen, lines = {}, {d: (t or "").split("\n") for d, t in rows}
    for d in sorted(lines):
        for i in range(len(lines[d]) - k + 1):
            seen.setdefault(tuple(lines[d][i : i + k]), (d, i))
    out = {}
    for d, ls in lines.items():
        gone = {j for i in range(len(ls) - k + 1) if seen[tuple(ls[i : i + k])] < (d, i) for j in range(i, i + k)}
        out[d] = "\n".join(x for j, x in enumerate(ls) if j not in gone)
    return out

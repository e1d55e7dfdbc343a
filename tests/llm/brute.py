"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_base(text):
    """kind:start:end of the base matches."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def repeats(texts, width=200):
    """For each text: removed bytes as a list of booleans."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return raw, out


def op1_rows(docs, width=200):
    raw, gone = repeats([t for _, t in docs], width)
    rows = []
    for (i, _), r, g in zip(docs, raw, gone):
        spans = sum(a and not b for a, b in zip(g, [False, *g]))
        rows.append((i, len(r), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(r, g) if not x)).hexdigest()))
    return rows


LOW = {i: i + 32 for i in range(65, 91)}


def windows(words, size=13):
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def op2_rows(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    by = {}
    for i, t in items:
        for w in windows(find(t)):
            by.setdefault(w, set()).add(str(i) if i is not None else "")
    sizes = {len(w) for w in by}
    rows = []
    for i, t in docs:
        words = find(t)
        hit, got = [False] * len(words), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                if (k := tuple(words[a : a + n])) in by:
                    hit[a : a + n] = [True] * n
                    got |= by[k]
        n_hit = sum(hit)
        rows.append((i, len(words), n_hit, len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(words)))
    return rows


def op9_rows(docs):
    sets = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def op6_rows(vectors, k=5, every=50):
    import math

    fixed = {i: [math.floor(256.0 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = []
    for q in fixed:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(fixed[q], v)), i) for i, v in fixed.items() if i != q)
            rows += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return rows

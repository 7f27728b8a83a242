"""Plain single-machine versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS(low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5))))


def near_components(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)]"""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min(least[find(i)])) for i, (doc, _) in enumerate(rows)]


def repeats(rows, length=400):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept digest)]"""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


# The patterns of the contract, as given.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """[(start, end, kind)] of the base spans, sorted."""
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def bootstrapped(rows, rounds=3, min_digits=4, support=3, threshold=0.8, shape="^[0-9a-f]{32,}$"):
    """{doc_id: {(start, end, kind)}} that contexts add to the base spans; rows are distinct."""
    blank = r"\x20\x09-\x0D"

    def patterns(text, start, end):
        trim = lambda w: re.sub(r"^[.,;!?()]+|[.,;!?()]+$", "", w)
        two = [trim(w) for w in (["", ""] + re.findall(f"[^{blank}]+", text[max(start - 60, 0) : start].lower()))[-2:]]
        after = trim(re.match(f"[{blank}]*([^{blank}]*)", text[end : end + 60].lower())[1])
        made = {f"{two[1]} _".strip(), f"{two[0]} {two[1]} _".strip(), f"_ {after}".strip()}
        return {p for p in made if re.sub(r"[_ |]", "", p)}

    occurrences = []  # doc, start, end, kind, text, new, patterns
    for doc, text in rows:
        base = personal(text)
        at = {}
        for kind, pattern in PII.items():
            ends = [(0, 0)] + [m.span() for m in re.finditer(pattern, text)]
            at |= {(kind, b): a[1] for a, b in zip(ends, ends[1:])}
        for start, end, kind in base:
            gap = text[at[kind, (start, end)] : start]
            nexts = [m.start() for m in re.finditer(PII[kind], text) if m.start() >= end]
            held = patterns(gap + text[start : nexts[0] if nexts else None], len(gap), len(gap) + end - start)
            occurrences.append((doc, start, end, kind, text[start:end], False, held))
        spans = [m.span() for m in re.finditer(f"[^{blank}]+", text) if re.search("[0-9@]", m[0])]
        for i, (a, b) in enumerate(spans):
            m = re.match(r"([^A-Za-z0-9]*)([A-Za-z0-9](?:.*[A-Za-z0-9])?)?", text[a:b])
            core, start = m[2] or "", a + len(m[1])
            end = start + len(core)
            if not ("@" in core or len(re.sub("[^0-9]", "", core)) >= min_digits) or any(start < y and x < end for x, y, _ in base):
                continue
            low, high = spans[i - 1][1] if i else 0, spans[i + 1][0] if i + 1 < len(spans) else len(text)
            held = patterns(text[low:high], a - low, b - low)
            occurrences.append((doc, start, end, "secret" if re.search(shape, core) else None, core, True, held))
    edges = {}
    for _, _, _, kind, text, _, held in occurrences:
        for p in held:
            edges[p, text] = max(filter(None, (edges.get((p, text)), kind)), default=None)
    seeds = {(t, k): 1.0 for (_, t), k in edges.items() if k}
    of, instances = {}, Counter(p for p, _ in edges)
    for p, t in edges:
        of.setdefault(t, []).append(p)

    def scored(belief):
        total, count = Counter(), Counter()
        for (t, k), b in belief:
            for p in of[t]:
                total[p, k] += b
                count[p, k] += b == 1.0
        return {(p, k): total[p, k] / (instances[p] + 1) for p, k in total if count[p, k] >= support}

    belief = list(seeds.items())
    for _ in range(rounds):
        scores, spread = scored(belief), {}
        for (p, t), kind in edges.items():
            if not kind:
                for (q, k), score in scores.items():
                    if q == p:
                        spread[t, k] = max(spread.get((t, k), 0), score)
        belief = [*seeds.items(), *spread.items()]
    scores = {x: s for x, s in scored(belief).items() if s >= threshold}
    sure = {x for x, b in belief if b >= threshold}
    found = {}
    for doc, start, end, _, text, new, held in occurrences:
        fits = [(s, k) for (p, k), s in scores.items() if new and p in held and (text, k) in sure]
        if fits:
            found.setdefault(doc, set()).add((start, end, max(fits)[1]))
    return found


def bm25(rows, queries, k=10, k1=1.2, b=0.75):
    docs = [(d, Counter(WORDS((t or "").lower()))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    mean = sum(sum(c.values()) for _, c in docs) / max(len(docs), 1)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in queries:
        terms = sorted(set(WORDS((text or "").lower())) & df.keys())
        scored = []
        for d, c in docs:
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            s = sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + norm) for t in terms if t in c)
            if s > 0:
                scored.append((-round(s, 9), d))
        out += [(q, i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def fill(sizes, weights, most):
    """Targets by resharing the excess until none is above its cap."""
    total, open_, target = sum(sizes.values()), set(sizes), {s: 0.0 for s in sizes}
    rest = float(total)
    while open_ and rest > 1e-9:
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = level * weights[s]
            break
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
        open_ -= over
    return target

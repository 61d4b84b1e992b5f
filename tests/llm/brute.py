"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k=5):
    words = NOT_SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(nodes, links):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            for n in (a, b):
                if best[n] > low:
                    best[n], changed = low, True
    return best


def jaccard(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((key, len(words), len(hit), sorted(x for x in found if x is not None)))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets of sources by filling and resharing until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target

"""Plain Python versions of the operators."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, pattern=SPACE, lower=False):
    text = text or ""
    return pattern.findall(text.translate(_LOWER) if lower else text)


def contamination(text, items, window=10):
    index = {}
    for item, body in items:
        w = words(body, ALNUM, True)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n and item is not None else ():
            index.setdefault(tuple(w[s:s + n]), set()).add(str(item))
    w, hit, found = words(text, ALNUM, True), set(), set()
    for n in {len(k) for k in index}:
        for s in range(len(w) - n + 1):
            if tuple(w[s:s + n]) in index:
                hit |= set(range(s, s + n))
                found |= index[tuple(w[s:s + n])]
    return len(w), len(hit), sorted(found)


def substrings(docs, length=100):
    """{key: (n_bytes, n_removed, n_spans, sha256)} for (key, text) in order."""
    seen, out = set(), {}
    for key, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone[s:s + length] = [True] * length
            seen.add(data[s:s + length])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def components(docs, k, percent=80):
    """[(n_shingles, component_id)] for (id, text)."""
    sets = []
    for _, text in docs:
        w = words(text, lower=True)
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (id_, _) in enumerate(docs):
        known = [x for x in (least.get(find(i)), id_) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(len(s), least[find(i)] if s else docs[i][0]) for i, s in enumerate(sets)]


def base_quality(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = set(), share * sum(sizes.values())
    while True:
        free = sum(weigh[s] for s in order if s not in stopped)
        rest = total - sum(most * sizes[s] for s in stopped)
        out = {s: most * sizes[s] if s in stopped else rest * weigh[s] / free for s in order}
        more = {s for s in order if out[s] > most * sizes[s]}
        if not more - stopped:
            return out
        stopped |= more

"""Plain versions of the operators, by definition and without filters."""

import re
from itertools import combinations


def shingles(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def jaccard_components(rows, width, percent):
    """{doc_id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for a, b in combinations(ids, 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed_words(rows, width=13):
    """[(doc_id, n_words, n_removed, kept words)] in the order of the rows."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out

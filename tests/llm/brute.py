"""Brute-force versions."""

from collections import Counter


def brute_components(docs, width=5):
    sets = []
    for key, text in docs:
        words = text.encode().lower().split()
        n = min(width, len(words))
        sets.append((key, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()))
    root = {k: k for k, _ in sets if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return Counter((k, len(s), None if k is None else find(k)) for k, s in sets)

"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def leaks(texts: dict[int, str | None], items: dict[int, str | None], least: float = 0.8, k: int = 5) -> dict[tuple[int, int], float]:
    out = {}
    for i, item in items.items():
        w = words(item)
        n = min(k, len(w))
        if not n:
            continue
        grams = lambda x, n=n: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
        own = grams(w)
        for d, text in texts.items():
            said = words(text)
            size = min(len(w), len(said))
            best = 0.0
            for s in range(len(said) - size + 1):
                seen = grams(said[s : s + size])
                both = sum((seen & own).values())
                total = sum(seen.values()) + sum(own.values()) - both
                best = max(best, both / total if total else 0.0)
            if best >= least:
                out[d, i] = best
    return out


def dedup_lines(texts: list[tuple[int, str | None]], width: int = 3) -> dict[int, str | None]:
    """Texts by doc_id with later copies of windows cut; doc_ids are distinct."""
    seen: dict[tuple, tuple[int, int]] = {}
    full = {}
    for d, text in sorted(texts):
        lines = [] if text is None else text.split("\n")
        full[d] = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
        for j in range(len(full[d]) - width + 1):
            seen.setdefault(tuple(x for _, x in full[d][j : j + width]), (d, j))
    out: dict[int, str | None] = {}
    for d, text in texts:
        gone: set[int] = set()
        for j in range(len(full[d]) - width + 1):
            first = seen[tuple(x for _, x in full[d][j : j + width])]
            if first != (d, j) and (first[0] != d or j - first[1] >= width):
                gone |= set(range(full[d][j][0], full[d][j + width - 1][0] + 1))
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out

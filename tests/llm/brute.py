"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jaccard(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(id, n, component) of every row, from all pairs."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(FOLD))
        size = min(5, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by_token: dict[tuple, list[int]] = {}
    for at, one in enumerate(sets):
        partners = {other for token in one for other in by_token.get(token, ())}
        for other in partners:
            common = len(one & sets[other])
            if 100 * common >= 80 * (len(one) + len(sets[other]) - common):
                root[find(at)] = find(other)
        for token in one:
            by_token.setdefault(token, []).append(at)
    least: dict[int, int] = {}
    for at, (key, _) in enumerate(rows):
        if key is not None:
            least[find(at)] = min(key, least.get(find(at), key))
    return [
        (key, len(sets[at]), least.get(find(at)) if sets[at] else key)
        for at, (key, _) in enumerate(rows)
    ]

"""Similarity of the fixture's names written out plainly, one pair at a time, for the SQL twins."""

from __future__ import annotations

import math

from reckon.sources.fixture import VENDORS


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken: list[int] = []
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == c:
                taken.append(j)
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(c != b[j] for c, j in zip(left, sorted(taken)))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def similarity(a: str, b: str) -> float:
    """Of two names of one word each: their Jaro-Winkler, or .97 of .92 where their consonants agree."""
    bare = lambda w: w[0] + "".join(c for c in w[1:] if c not in "aeiou")
    best = jaro_winkler(a, b)
    alike = bare(a) in (bare(b), b) or bare(b) == a
    return math.floor(max(best, 0.97 * max(best, 0.92 if alike else 0)) * 100 + 0.5) / 100


def changed(name: str) -> list[str]:
    """A name as others might write it: a letter lost, two exchanged, one more, the vowels left out."""
    return [name[:-1], name[1] + name[0] + name[2:], name + "s", name[0] + "".join(c for c in name[1:] if c not in "aeiou") + "n"]


def table(pairs: list[tuple[str, str]], columns: str) -> str:
    """A derived table of pairs with their Jaro-Winkler and similarity."""
    rows = ", ".join(f"('{a}', '{b}', {jaro_winkler(a, b)!r}::DOUBLE, {similarity(a, b)!r}::DOUBLE)" for a, b in pairs)
    return f"(VALUES {rows}) AS {columns}"


#: (a, b, jw, sim) of all pairs of the fixture's vendors.
NAMES = table([(a, b) for a in VENDORS for b in VENDORS], "nm(a, b, jw, sim)")

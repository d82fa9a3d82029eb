"""Plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def words(text: str | None) -> list[str]:
    return SPACE_WORD.findall(text or "")


def quality_base(text: str | None) -> tuple:
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    runs = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k + j for k in range(len(ws) - 2) if runs[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    return (
        len(ws),
        sum(map(len, ws)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def shingle_set(text: str | None, k: int = 4) -> frozenset:
    ws = words(lower(text))
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def components(sets: list[frozenset], num: int = 85, den: int = 100) -> list[int]:
    """The least position reachable by links."""
    parent = list(range(len(sets)))

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


def windows_hit(text: str | None, items: dict[str, str | None], n: int = 13) -> tuple[int, set[int], set[str]]:
    ws, hit, ids = TOKEN.findall(lower(text)), set(), set()
    for item, body in items.items():
        own = TOKEN.findall(lower(body))
        size = min(n, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(ws) - size + 1):
            if tuple(ws[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                ids.add(item)
    return len(ws), hit, ids


def without_repeated(texts: list[str | None], n: int = 200) -> list[tuple[int, int, bytes]]:
    """Removed bytes, removed runs and what is left of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + n] for b in bodies for k in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out

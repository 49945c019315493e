"""Masks as sorted, disjoint lists of (start, length), merged without pixels.

Small helpers for one mask in a step function. Whole tables of masks are
combined by ``operators.runs``.
"""

from __future__ import annotations

import math

Runs = list[tuple[int, int]]


def of_box(x1: float, y1: float, x2: float, y2: float, width: int, height: int) -> Runs:
    """Pixels of a box, cut at the frame's borders."""
    a, b, c, d = max(0, int(x1)), max(0, int(y1)), min(width, int(x2)), min(height, int(y2))
    return [(y * width + a, c - a) for y in range(b, d)] if c > a else []


def area(runs: Runs) -> int:
    return sum(n for _, n in runs)


def swept(a: Runs, b: Runs, keep) -> Runs:
    """The pixels for which ``keep(in a, in b)`` holds, by one sweep over the borders of both."""
    borders = sorted([(s, 0, 1) for s, _ in a] + [(s + n, 0, -1) for s, n in a] + [(s, 1, 1) for s, _ in b] + [(s + n, 1, -1) for s, n in b])
    depth, out, start, at = [0, 0], [], None, 0
    while at < len(borders):
        place = borders[at][0]
        while at < len(borders) and borders[at][0] == place:
            depth[borders[at][1]] += borders[at][2]
            at += 1
        inside = keep(depth[0] > 0, depth[1] > 0)
        if inside and start is None:
            start = place
        elif not inside and start is not None:
            out.append((start, place - start))
            start = None
    return out


def union(a: Runs, b: Runs) -> Runs:
    return swept(a, b, lambda x, y: x or y)


def common(a: Runs, b: Runs) -> Runs:
    return swept(a, b, lambda x, y: x and y)


def without(a: Runs, b: Runs) -> Runs:
    return swept(a, b, lambda x, y: x and not y)


def by_row(runs: Runs, width: int) -> Runs:
    """Runs that cross the end of a row, taken apart there."""
    out = []
    for s, n in runs:
        while n > 0:
            k = min(n, width - s % width)
            out.append((s, k))
            s, n = s + k, n - k
    return out


def reach(radius: int) -> list[tuple[int, int]]:
    """Rows of a disc-like kernel: (offset, half width)."""
    return [(dy, round(math.sqrt(radius * radius - dy * dy))) for dy in range(-radius, radius + 1)]


def dilated(runs: Runs, radius: int, width: int, height: int) -> Runs:
    """Grown by the kernel of ``reach``, inside the frame."""
    grown: Runs = []
    for s, n in by_row(runs, width):
        y, x = divmod(s, width)
        for dy, half in reach(radius):
            if 0 <= y + dy < height:
                a, b = max(0, x - half), min(width, x + n + half)
                grown.append(((y + dy) * width + a, b - a))
    return union(grown, [])


def extent(runs: Runs, width: int) -> tuple[int, int, int, int] | None:
    """x1, y1, x2, y2 of the box around a mask, ends exclusive."""
    parts = by_row(runs, width)
    if not parts:
        return None
    return min(s % width for s, _ in parts), parts[0][0] // width, max(s % width + n for s, n in parts), parts[-1][0] // width + 1


def centre(runs: Runs, width: int) -> tuple[float, float]:
    """Mean column and row of a mask that is not empty."""
    parts = by_row(runs, width)
    total = area(parts)
    return sum(n * (s % width + (n - 1) / 2) for s, n in parts) / total, sum(n * (s // width) for s, n in parts) / total

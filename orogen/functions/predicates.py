"""Exact signs of orientation and in-circle determinants, and the Delaunay kernel.

Doubles are scaled by a power of two to whole numbers, so that Python's integers
give exact signs. Points on one circle are told apart by ids: the smallest id
counts as lying a hair below the paraboloid, which makes the result one and the
same whatever the order of insertion and the tile.
"""

from __future__ import annotations

from collections import deque

import numpy as np

GHOST = -1


def whole(values: np.ndarray) -> list[int]:
    """The doubles times one common power of two, as exact integers."""
    if np.all(np.abs(values) < 2**53) and np.all(values == np.floor(values)):
        return [int(v) for v in values]
    ratios = [float(v).as_integer_ratio() for v in values]
    scale = max((d for _, d in ratios), default=1)
    return [n * (scale // d) for n, d in ratios]


class Plane:
    """Points with integer coordinates, known by their place in the list."""

    def __init__(self, ids: list[int], x: np.ndarray, y: np.ndarray) -> None:
        both = whole(np.concatenate((np.asarray(x, dtype=float), np.asarray(y, dtype=float))))
        self.ids, self.x, self.y = ids, both[: len(ids)], both[len(ids) :]

    def orient(self, a: int, b: int, c: int) -> int:
        x, y = self.x, self.y
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    def incircle(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d is inside the circle of the counter-clockwise a, b, c; ties by the smallest id."""
        x, y = self.x, self.y
        ax, ay, bx, by, cx, cy = x[a] - x[d], y[a] - y[d], x[b] - x[d], y[b] - y[d], x[c] - x[d], y[c] - y[d]
        det = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if det:
            return det > 0
        opposite = c if self.orient(a, b, d) < 0 else a if self.orient(b, c, d) < 0 else b
        ids = self.ids
        return min(ids[d], ids[opposite]) < min(ids[k] for k in (a, b, c) if k != opposite)


class Delaunay:
    """Triangulation by insertion; ``apex[(u, v)]`` is the third corner left of the edge."""

    def __init__(self, plane: Plane) -> None:
        self.p = plane
        self.apex: dict[tuple[int, int], int] = {}
        order = self._order()
        first = self._first(order)
        if first is None:
            return
        for k in range(3):
            u, v, w = first[k], first[(k + 1) % 3], first[(k + 2) % 3]
            self.apex[u, v] = w
            self._add(v, u, GHOST)
        self.last = first[0], first[1]
        taken = set(first)
        for i in order:
            if i not in taken:
                self._insert(i)

    def _order(self) -> list[int]:
        """Points along a Z curve, so that the next one is near."""
        x, y = self.p.x, self.p.y
        if not x:
            return []
        x0, y0 = min(x), min(y)
        span = max(max(x) - x0, max(y) - y0, 1)

        def key(i: int) -> int:
            a, b, out = (x[i] - x0) * 1023 // span, (y[i] - y0) * 1023 // span, 0
            for bit in range(10):
                out |= (a >> bit & 1) << 2 * bit | (b >> bit & 1) << 2 * bit + 1
            return out

        return sorted(range(len(x)), key=lambda i: (key(i), x[i], y[i]))

    def _first(self, order: list[int]) -> tuple[int, int, int] | None:
        for k in range(2, len(order)):
            turn = self.p.orient(order[0], order[1], order[k])
            if turn:
                return (order[0], order[1], order[k]) if turn > 0 else (order[1], order[0], order[k])
        return None

    def _add(self, u: int, v: int, w: int) -> None:
        self.apex[u, v] = w
        self.apex[v, w] = u
        self.apex[w, u] = v

    def _conflict(self, u: int, v: int, w: int, q: int) -> bool:
        if GHOST not in (u, v, w):
            return self.p.incircle(u, v, w, q)
        while w != GHOST:
            u, v, w = v, w, u
        turn = self.p.orient(u, v, q)
        if turn:
            return turn > 0
        x, y = self.p.x, self.p.y
        return (x[q] - x[u]) * (x[q] - x[v]) + (y[q] - y[u]) * (y[q] - y[v]) < 0

    def _find(self, q: int) -> tuple[int, int, int]:
        """A triangle that conflicts with q, reached by walking."""
        u, v = self.last
        w = self.apex[u, v]
        if w == GHOST:
            u, v = v, u
            w = self.apex[u, v]
        while w != GHOST:
            for a, b in ((u, v), (v, w), (w, u)):
                if self.p.orient(a, b, q) < 0:
                    u, v, w = b, a, self.apex[b, a]
                    break
            else:
                return u, v, w
        return u, v, w

    def _insert(self, q: int) -> None:
        start = self._find(q)
        gone, queue, border = {frozenset(start)}, deque([start]), []
        remove = []
        while queue:
            u, v, w = queue.popleft()
            remove.append((u, v, w))
            for a, b in ((u, v), (v, w), (w, u)):
                c = self.apex[b, a]
                key = frozenset((b, a, c))
                if key in gone:
                    continue
                if self._conflict(b, a, c, q):
                    gone.add(key)
                    queue.append((b, a, c))
                else:
                    border.append((a, b))
        for u, v, w in remove:
            for e in ((u, v), (v, w), (w, u)):
                self.apex.pop(e, None)
        for a, b in border:
            self._add(a, b, q)
            if GHOST not in (a, b):
                self.last = a, b

    def triangles(self) -> list[tuple[int, int, int]]:
        """Counter-clockwise triangles, each once."""
        return [(u, v, w) for (u, v), w in self.apex.items() if GHOST not in (u, v, w) and u < v and u < w]

    def filled(self, edges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Triangles reached from the left of the given directed edges without crossing any of them."""
        stop, seen, out = set(edges), set(), []
        queue = deque(edges)
        while queue:
            u, v = queue.popleft()
            w = self.apex.get((u, v))
            if w is None or w == GHOST or frozenset((u, v, w)) in seen:
                continue
            seen.add(frozenset((u, v, w)))
            out.append((u, v, w))
            queue.extend((b, a) for a, b in ((u, v), (v, w), (w, u)) if (a, b) not in stop)
        return out

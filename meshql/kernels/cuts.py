"""Cuts on one hemisphere: made continuous, refined along geodesics, merged, named. Ties go to the smaller vertex."""

from __future__ import annotations

import heapq
import math
from functools import cache

import numpy as np

from . import graph
from .graph import Adjacency

#: The names of the cuts, and the limits in mm.
CUT_NAMES = ("calcarine", "medial1", "medial2", "medial3", "temporal")
NEAR_WALL, ANCHOR_RADIUS = 10.0, 15.0

Points = dict[int, np.ndarray]


def _matrix(points: Points, ids: list[int]) -> np.ndarray:
    return points.matrix(ids) if hasattr(points, "matrix") else np.array([points[i] for i in ids])


def gaps(points: Points, a: list[int], b: list[int], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Of each of a, the distance to the nearest of b and the first such one's place; in blocks of both, so that the memory is bounded."""
    p, q = _matrix(points, a), _matrix(points, b)
    near, at = np.full(len(a), np.inf), np.zeros(len(a), dtype=int)
    for i in range(0, len(a), block):
        for j in range(0, len(b), 2 * block):
            d = np.sqrt(((p[i : i + block, None, :] - q[None, j : j + 2 * block]) ** 2).sum(axis=2))
            k = d.argmin(axis=1)
            low = d[np.arange(len(k)), k]
            at[i : i + block] = np.where(low < near[i : i + block], k + j, at[i : i + block])
            near[i : i + block] = np.minimum(low, near[i : i + block])
    return near, at


def farthest_pair(points: Points, ids: list[int]) -> tuple[int, int, float]:
    ids = sorted(ids)
    best = (ids[0], ids[0], 0.0)
    p = _matrix(points, ids)
    for i, x in enumerate(ids):
        d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        j = int(d.argmax())
        if d[j] > best[2]:
            best = (x, ids[j], float(d[j]))
    return best


def farthest(points: Points, start: int, ids: list[int]) -> tuple[int, float]:
    if not ids:
        return start, 0.0
    ids = sorted(ids)
    d = np.sqrt(((_matrix(points, ids) - points[start]) ** 2).sum(axis=1))
    return ids[int(d.argmax())], float(d.max())


def parts(adj: Adjacency, members: set[int]) -> list[list[int]]:
    """Connected parts of members, each sorted, larger first."""
    left, out = set(members), []
    for s in sorted(members):
        if s in left:
            left.discard(s)
            queue, own = [s], [s]
            while queue:
                for y, _ in adj.get(queue.pop(), ()):
                    if y in left:
                        left.discard(y)
                        own.append(y)
                        queue.append(y)
            out.append(sorted(own))
    return sorted(out, key=lambda c: (-len(c), c[0]))


def _ends(adj: Adjacency, points: Points, part: list[int]) -> tuple[int, int]:
    if len(part) == 1:
        return part[0], part[0]
    own = set(part)
    tips = [v for v in part if sum(y in own for y, _ in adj.get(v, ())) == 1]
    if len(tips) > 1:
        return farthest_pair(points, tips)[:2]
    if tips:
        return tips[0], farthest(points, tips[0], part)[0]
    one = farthest(points, part[0], part)[0]
    return one, farthest(points, one, part)[0]


def continuous(adj: Adjacency, points: Points, cut: set[int]) -> set[int]:
    """The cut with its parts joined by shortest paths: from one end of the two parts whose ends are farthest apart, always to the nearest part, until all are joined.

    A part that no path reaches is left as it is.
    """
    own = parts(adj, cut)
    if len(own) < 2:
        return set(cut)
    ends = [(v, i) for i, p in enumerate(own) for v in _ends(adj, points, p)]
    far = max(((float(np.linalg.norm(points[a] - points[b])), -x, -y, i) for x, (a, i) in enumerate(ends) for y, (b, j) in enumerate(ends) if i != j), default=None)
    joined, left, out = {far[3]}, set(range(len(own))) - {far[3]}, set(cut)

    @cache
    def gap(i: int, j: int) -> tuple[float, int, int, int]:
        d, at = gaps(points, own[i], own[j])
        k = int(d.argmin())
        return float(d[k]), own[i][k], own[j][int(at[k])], j

    while left:
        best = min(gap(i, j) for i in sorted(joined) for j in sorted(left))
        found = graph.paths(adj, best[1], {best[2]})
        left.discard(best[3])
        if best[2] in found:
            out |= set(found[best[2]][1])
            joined.add(best[3])
    return out


def refined(adj: Adjacency, points: Points, cut: list[int], wall: set[int]) -> list[int]:
    """A shortest path in place of the cut, and what it traps: from the cut's vertex farthest from the wall to the wall's rim, keeping clear of the wall."""
    if len(cut) < 2:
        return list(cut)
    cut = sorted(set(cut))
    start, end, _ = farthest_pair(points, cut)
    if wall:
        walls = sorted(wall)
        away, _ = gaps(points, cut, walls)
        rim = sorted({y for w in walls for y, _ in adj.get(w, ()) if y not in wall})
        near = [c for c, d in zip(cut, away, strict=True) if d < NEAR_WALL] or [cut[int(away.argmin())]]
        if rim:
            d, _ = gaps(points, rim, near)
            anchors = [r for r, x in zip(rim, d, strict=True) if x < ANCHOR_RADIUS]
            if not anchors:
                d, _ = gaps(points, rim, [cut[int(away.argmin())]])
                anchors = [rim[int(d.argmin())]]
            source = cut[int(away.argmax())]
            found = graph.paths(adj, source, set(anchors))
            if found:
                passed = sorted({v for _, walk in found.values() for v in walk})
                free = dict(zip(passed, gaps(points, passed, walls)[0].tolist(), strict=True))
                clear = {a: min(free[v] for v in walk) for a, (_, walk) in found.items()}
                start, end = source, max(sorted(clear), key=lambda a: clear[a])
    found = graph.paths(adj, start, {end})
    if end not in found:
        return list(cut)
    walk = found[end][1]
    return [*walk, *sorted(graph.trapped(adj, wall | set(walk), walk[-1]))]


def absorb_regions(adj: Adjacency, points: Points, cuts: dict[str, list[int]], wall: set[int], vertices: set[int]) -> dict[str, list[int]]:
    """Parts of the patch other than the largest go to the nearest cut, one after another; a region counts as its cut for the next."""
    rest = vertices - wall - {v for c in cuts.values() for v in c}
    return absorbed(points, cuts, parts(adj, rest)[1:])


def absorbed(points: Points, cuts: dict[str, list[int]], regions: list[list[int]]) -> dict[str, list[int]]:
    """Cuts with each region added to the nearest, one after another; where there is one cut alone it is that."""
    out = {k: list(v) for k, v in cuts.items()}
    there = [k for k in sorted(out) if out[k]]
    for region in regions:
        if there:
            k = there[0] if len(there) == 1 else min((float(gaps(points, region, out[k])[0].min()), k) for k in there)[1]
            out[k] += region
    return out


def merge_small(components: list[set[int]], wall: set[int], rim: set[int], points: Points, keep: int = 5) -> tuple[set[int], list[set[int]]]:
    """Components beyond the `keep` largest go to the nearest of those or to the wall, one after another; too few are padded with empty sets."""
    own = [sorted(c) for c in components]
    ids = [v for c in own for v in c]
    xyz, edge = (_matrix(points, x) if x else np.zeros((0, 3)) for x in (ids, sorted(rim)))
    to = nearest_mains(xyz, np.repeat(np.arange(len(own)), [len(c) for c in own]), edge, keep)
    wall, mains = set(wall), [set() for _ in range(keep)]
    for c, i in zip(own, to.tolist(), strict=True):
        (wall if i == keep else mains[i]).update(c)
    return wall, mains


#: Points of a leaf of the tree.
LEAF = 32


class _Tree:
    """Points in boxes that halve down to leaves. What is put in by and by, with a number, can be searched for the nearest; boxes without any such point are passed by."""

    def __init__(self, xyz: np.ndarray) -> None:
        self.order, self.spans, self.children, self.parents = np.arange(len(xyz)), [], [], []
        todo = [(0, len(xyz), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = len(self.spans)
            self.spans.append((a, b))
            self.children.append(())
            self.parents.append(parent)
            if parent >= 0:
                self.children[parent] += (at,)
            if b - a > LEAF:
                own = self.order[a:b]
                x = xyz[own]
                mid = (b - a) // 2
                self.order[a:b] = own[np.argpartition(x[:, int(np.ptp(x, axis=0).argmax())], mid)]
                todo += [(a, a + mid, at), (a + mid, b, at)]
        self.xyz, self.place = xyz[self.order], np.empty(len(xyz), dtype=np.int64)
        self.place[self.order] = np.arange(len(xyz))
        self.low, self.high = ([f(self.xyz[a:b], axis=0).tolist() if b > a else [0.0] * 3 for a, b in self.spans] for f in (np.min, np.max))
        leaves = [i for i, c in enumerate(self.children) if not c]
        first = np.array([self.spans[i][0] for i in leaves])
        by_place = np.argsort(first, kind="stable")
        self.first, self.leaf = first[by_place], np.array(leaves)[by_place]
        self.live = [False] * len(self.spans)
        self.number = np.full(len(xyz), -1, dtype=np.int64)

    def put(self, places: np.ndarray, number: int) -> None:
        self.number[places] = number
        for i in np.unique(self.leaf[np.searchsorted(self.first, places, "right") - 1]).tolist():
            while i >= 0 and not self.live[i]:
                self.live[i] = True
                i = self.parents[i]

    def nearest(self, places: np.ndarray) -> int:
        """The number that lies nearest to any of the places, the least of those equally near. A box is left out only if it can't hold a point as near: its distance is rounded in the same steps as theirs."""
        best, found = float("inf"), 0
        for s in range(0, len(places), 2 * LEAF):
            own = self.xyz[places[s : s + 2 * LEAF]]
            low, high = own.min(axis=0).tolist(), own.max(axis=0).tolist()

            def away(i: int) -> float:
                total = 0.0
                for a, b, c, d in zip(low, high, self.low[i], self.high[i], strict=True):
                    gap = max(c - b, a - d, 0.0)
                    total += gap * gap
                return math.sqrt(total)

            heap = [(away(0), 0)] if self.live and self.live[0] else []
            while heap:
                d, i = heapq.heappop(heap)
                if d > best:
                    break
                for c in self.children[i]:
                    if self.live[c] and (far := away(c)) <= best:
                        heapq.heappush(heap, (far, c))
                if not self.children[i]:
                    a, b = self.spans[i]
                    number = self.number[a:b]
                    held = number >= 0
                    least = np.sqrt(((own[:, None, :] - self.xyz[None, a:b][:, held]) ** 2).sum(axis=2)).min(axis=0)
                    if (near := float(least.min())) <= best:
                        first = int(number[held][least == near].min())
                        found = first if near < best else min(first, found)
                        best = near
        return found


def nearest_mains(xyz: np.ndarray, component: np.ndarray, rim: np.ndarray, keep: int) -> np.ndarray:
    """For each component, in order, the main one that it comes to, or `keep` for the wall. The first `keep` are the mains; every other goes to the nearest, of which it is a part for the next, or to the wall where the rim is nearer.

    xyz: places of the components' points, sorted by component; rim: those of the wall's rim, which stays as it is. In a tree of all points a component is compared with what lies around it alone.
    """
    ends = np.searchsorted(component, np.arange(component.max(initial=-1) + 2))
    n, total = len(ends) - 1, len(xyz)
    to = np.minimum(np.arange(n), keep)
    if n <= keep:
        return to
    tree = _Tree(np.concatenate([xyz, rim]))
    if len(rim):
        tree.put(tree.place[total:], keep)
    for c in range(n):
        own = np.sort(tree.place[ends[c] : ends[c + 1]])
        if c >= keep:
            to[c] = tree.nearest(own)
        if to[c] < keep:
            tree.put(own, int(to[c]))
    return to

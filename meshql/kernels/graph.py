"""Graphs: components, loops, rings, shortest paths, holes, cuts."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

Adjacency = dict[int, list[tuple[int, float]]]


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted vertices of the edges, and the smallest vertex of each one's component. Labels sink over all edges at once and are shortened."""
    vid, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    s, t = at[: len(u)], at[len(u) :]
    label = np.arange(len(vid))
    while True:
        low = np.minimum(label[s], label[t])
        fresh = label.copy()
        np.minimum.at(fresh, label[s], low)
        np.minimum.at(fresh, label[t], low)
        while not np.array_equal(nxt := fresh[fresh], fresh):
            fresh = nxt
        if np.array_equal(fresh, label):
            return vid, vid[label]
        label = fresh


def loops(u: list[int], v: list[int]) -> list[list[int]]:
    """Walks over all edges of a boundary graph, each from its smallest vertex on, by smaller neighbours first."""
    near: dict[int, set[int]] = defaultdict(set)
    for a, b in zip(u, v, strict=True):
        near[a].add(b)
        near[b].add(a)
    out = []
    for start in sorted(near):
        while near[start]:
            walk, at = [start], start
            while near[at]:
                to = min(near[at])
                near[at].discard(to)
                near[to].discard(at)
                if to == start:
                    break
                walk.append(to)
                at = to
            out.append(walk)
    return out


def boundary(faces: np.ndarray) -> np.ndarray:
    """Edges (u < v) of exactly one face."""
    pairs = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    found, n = np.unique(pairs, axis=0, return_counts=True)
    return found[n == 1]


def fill_holes(faces: np.ndarray, excluded: set[int], rounds: int = 10) -> set[int]:
    """Vertices that have to go as well until the patch has one simple boundary."""
    added: set[int] = set()
    for _ in range(rounds):
        gone = np.isin(faces, list(excluded | added)).any(axis=1)
        rim = boundary(faces[~gone]) if (~gone).any() else np.zeros((0, 2), dtype=np.int64)
        if not len(rim):
            break
        vid, n = np.unique(rim, return_counts=True)
        more = set(vid[n > 2].tolist())
        if not more:
            nodes, comp = components(rim[:, 0], rim[:, 1])
            first, size = np.unique(comp, return_counts=True)
            keep = first[np.lexsort((first, -size))[0]]
            more = set(nodes[comp != keep].tolist())
        if not more:
            break
        added |= more
    return added


def adjacency(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Adjacency:
    out: Adjacency = defaultdict(list)
    for a, b, d in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        out[a].append((b, d))
    return out


def rings(adj: Adjacency, source: int, k: int) -> dict[int, int]:
    """Vertex: hops from the source, for 1 to k hops."""
    hop, edge = {source: 0}, [source]
    for h in range(1, k + 1):
        nxt = []
        for x in edge:
            for y, _ in adj.get(x, ()):
                if y not in hop:
                    hop[y] = h
                    nxt.append(y)
        edge = nxt
    del hop[source]
    return hop


def ring_pairs(pairs: np.ndarray, sources: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, vertex, hops) of everything up to k hops from the sources, all sources stepping at once. pairs: edges sorted by their first end, both ways for all that lies nearer than k."""
    first = np.searchsorted(pairs[:, 0], np.arange(pairs.max() + 2 if len(pairs) else 1))
    degree, width = np.diff(first), len(first)
    src = dst = sources[sources < len(degree)]
    seen, out = np.sort(src * width + dst), []
    for hop in range(1, k + 1):
        n = degree[dst]
        at = np.repeat(first[dst] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.unique(np.repeat(src, n) * width + pairs[at, 1])
        spot = np.searchsorted(seen, key)
        spot[spot == len(seen)] = 0
        key = key[seen[spot] != key] if len(seen) else key
        src, dst = key // width, key % width
        out.append((src, dst, np.full(len(key), hop)))
        seen = np.union1d(seen, key)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tangent_angles(xyz: np.ndarray, normal: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Angle (0 to 2 pi) of dst in src's tangent plane, whose first axis comes from X, or from Y where the normal is near X."""
    ref = np.zeros_like(normal)
    along_x = np.abs(normal[:, 0]) < 0.9
    ref[along_x, 0] = ref[~along_x, 1] = 1.0
    t = ref - (ref * normal).sum(axis=1)[:, None] * normal
    t /= np.sqrt((t * t).sum(axis=1))[:, None]
    d = xyz[dst] - xyz[src]
    p, q = (d * t[src]).sum(axis=1), (d * np.cross(normal, t)[src]).sum(axis=1)
    return np.mod(np.arctan2(q, p), 2 * np.pi)


def angular_pick(src: np.ndarray, dst: np.ndarray, hop: np.ndarray, angle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs kept, by src, hop and slot; their slots): of each ring the dst nearest to each of n sectors' centres, or a ring of up to n whole."""
    order = np.lexsort((dst, hop, src))
    s, h = src[order], hop[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(s)))
    small = size[group] <= n
    whole, slot = order[small], (np.arange(len(s)) - first[group])[small]
    spread, g, width = order[~small], group[~small], 2 * np.pi / n
    # within a width of a centre lie the sector that holds the angle and the next one only
    low = np.floor(angle[spread] / width).astype(np.int64) % n
    sector = np.concatenate([low, (low + 1) % n])
    at, g = np.concatenate([spread, spread]), np.concatenate([g, g])
    off = np.abs(angle[at] - sector * width)
    off = np.minimum(off, 2 * np.pi - off)
    near = off < width
    sector, at, g, off = sector[near], at[near], g[near], off[near]
    best = np.lexsort((dst[at], off, sector, g))
    sector, at, g = sector[best], at[best], g[best]
    lead = np.ones(len(at), dtype=bool)
    lead[1:] = (g[1:] != g[:-1]) | (sector[1:] != sector[:-1])
    sector, at = sector[lead], at[lead]
    once = np.lexsort((sector, at))  # a dst that is nearest to two sectors keeps the first
    sector, at = sector[once], at[once]
    lead = np.ones(len(at), dtype=bool)
    lead[1:] = at[1:] != at[:-1]
    at, slot = np.concatenate([whole, at[lead]]), np.concatenate([slot, sector[lead]])
    order = np.lexsort((slot, hop[at], src[at]))
    return at[order], slot[order]


def distances(adj: Adjacency, source: int, targets: set[int]) -> dict[int, float]:
    """Shortest path lengths to the targets over the whole graph; stops when all are settled. Those out of reach are left out."""
    best, done, left = {source: 0.0}, set(), set(targets)
    heap, out = [(0.0, source)], {}
    while heap and left:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x in left:
            left.discard(x)
            out[x] = d
        for y, w in adj.get(x, ()):
            e = d + w
            if e < best.get(y, np.inf):
                best[y] = e
                heapq.heappush(heap, (e, y))
    return out


def paths(adj: Adjacency, source: int, targets: set[int]) -> dict[int, tuple[float, list[int]]]:
    """Shortest paths to the targets, of equally long ones that over smaller vertices: {target: (length, vertices)}."""
    best, back, done, left = {source: 0.0}, {source: -1}, set(), set(targets)
    heap, out = [(0.0, source)], {}
    while heap and left:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x in left:
            left.discard(x)
            walk, at = [], x
            while at != -1:
                walk.append(at)
                at = back[at]
            out[x] = (d, walk[::-1])
        for y, w in adj.get(x, ()):
            e, old = d + w, best.get(y, np.inf)
            if e < old or e == old and y not in done and x < back[y]:
                best[y], back[y] = e, x
                heapq.heappush(heap, (e, y))
    return out


def trapped(adj: Adjacency, excluded: set[int], anchor: int, reach: int = 200, least: int = 100) -> set[int]:
    """Vertices around the anchor that excluded ones shut in: what a search from its free neighbours sees if that is under `least`; it stops at `reach`."""
    out: set[int] = set()
    for start in sorted(y for y, _ in adj.get(anchor, ()) if y not in excluded and y != anchor):
        if start in out:
            continue
        seen, queue = {start}, [start]
        while queue and len(seen) < reach:
            x = queue.pop(0)
            for y, _ in sorted(adj.get(x, ())):
                if y not in seen and y not in excluded and y != anchor:
                    seen.add(y)
                    queue.append(y)
        if len(seen) < least:
            out |= seen
    return out

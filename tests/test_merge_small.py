"""Small components come to the nearest main cut or to the wall by a search that looks around each, not over all that is there."""

import numpy as np
import pytest

from meshql.kernels import cuts as kernel
from meshql.operators import template


def plain(components, wall, rim, where, keep):
    """One after another, all against all."""
    wall, mains = set(wall), [set(c) for c in components[:keep]]

    def gap(a, b):
        p, q = (np.array([where[v] for v in x]) for x in (a, b))
        return float(np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min())

    for c in components[keep:]:
        found = [(gap(c, m), i) for i, m in enumerate(mains)] + ([(gap(c, rim), keep)] if rim else [])
        (wall if (i := min(found)[1]) == keep else mains[i]).update(c)
    return wall, mains + [set() for _ in range(keep - len(mains))]


def made(seed, whole):
    """Random components, largest first, and a rim; whole: on whole numbers, where distances are often equal."""
    rng = np.random.default_rng(seed)
    n, k, r = int(rng.integers(1, 200)), int(rng.integers(1, 25)), int(rng.integers(0, 6))
    xyz = rng.integers(0, int(rng.integers(2, 12)), (n + r, 3)).astype(float) if whole else rng.standard_normal((n + r, 3))
    of = rng.integers(0, k, n)
    parts = sorted(filter(None, (set(np.flatnonzero(of == i).tolist()) for i in range(k))), key=lambda c: (-len(c), min(c)))
    return parts, set(range(n, n + r)), dict(enumerate(xyz))


@pytest.mark.parametrize("whole", [True, False])
def test_equals_all_against_all(monkeypatch, whole):
    monkeypatch.setattr(kernel, "gaps", lambda *_: pytest.fail("a component is held against a whole cut"))
    for seed in range(40):
        monkeypatch.setattr(kernel, "LEAF", 1 + seed % 9)
        parts, rim, where = made(seed, whole)
        assert kernel.merge_small(parts, {9999}, rim, where, 1 + seed % 6) == plain(parts, {9999}, rim, where, 1 + seed % 6)


def test_operator_gives_the_kernels_rows(spark):
    parts, rim, where = made(7, True)
    wall = {max(where) + 1}
    where |= {max(wall): np.zeros(3)}
    rows = [("a", "lh", v, i) for i, c in enumerate([wall, *parts]) for v in c]
    points = spark.createDataFrame([("a", "lh", v, *map(float, p)) for v, p in where.items()], "subject string, hemi string, vid long, x double, y double, z double")
    found = template.merge_small(spark.createDataFrame(rows, "subject string, hemi string, vid long, part int"), points.where(points.vid.isin(sorted(rim))).select("subject", "hemi", "vid"), points, 4)
    whole, mains = plain(parts, wall, rim, where, 4)
    assert len(parts) > 4 and sorted(map(tuple, found.collect())) == sorted([("a", "lh", v, 0) for v in whole] + [("a", "lh", v, i) for i, c in enumerate(mains, 1) for v in c])

"""Mesh, metric and topology operators on small meshes worked out by hand."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshql.functions.vector import signed_area
from meshql.operators import cuts, energy, flatten, mesh, metrics, packs, report, rings, snapshots, template, topology
from meshql.kernels import cuts as cut_kernel
from meshql.kernels import descent, graph
from meshql.plans.meshgen import half_sphere, plain_grid, table_mesh

QUAD = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]
QUAD_FACES = [(0, 1, 2), (1, 3, 2)]
TWO_QUADS = QUAD + [(x + 3, y, z) for x, y, z in QUAD]
TWO_FACES = QUAD_FACES + [(4, 5, 6), (5, 7, 6)]
ANNULUS = [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
KEYED = "subject string, hemi string, "


def points(spark, xyz, ids=None):
    return spark.createDataFrame([("s", "lh", i, float(x), float(y), float(z)) for i, (x, y, z) in zip(ids or range(len(xyz)), xyz, strict=True)], KEYED + "vid long, x double, y double, z double")


def plane(spark, xy):
    return spark.createDataFrame([("s", "lh", i, float(p[0]), float(p[1])) for i, p in enumerate(xy)], KEYED + "vid long, u double, v double")


def faces(spark, rows):
    return spark.createDataFrame([("s", "lh", i, *r) for i, r in enumerate(rows)], KEYED + "fid long, a long, b long, c long")


def ids(spark, values, name="vid"):
    return spark.createDataFrame([("s", "lh", v) for v in values], KEYED + f"{name} long")


def one(df, c="vid"):
    return {r[c] for r in df.collect()}


def test_quad(spark):
    v, f = points(spark, QUAD), faces(spark, QUAD_FACES)
    assert topology.euler(v, f).first().asDict() == {"subject": "s", "hemi": "lh", "n_vertices": 4, "n_edges": 5, "n_faces": 2, "chi": 1}
    assert metrics.surface_area(f, v).first()["area"] == 1.0
    assert {(r["u"], r["v"]) for r in topology.boundary_edges(f).collect()} == {(0, 1), (0, 2), (1, 3), (2, 3)}
    assert [r["vid"] for r in topology.boundary_paths(f).orderBy("ord").collect()] == [0, 1, 3, 2]
    assert metrics.flipped(metrics.planar_areas(f, plane(spark, QUAD))).first()["n_flipped"] == 0
    assert metrics.area_split(metrics.planar_areas(f, plane(spark, QUAD))).first()["total"] == 1.0
    lengths = mesh.edge_lengths(mesh.edges(f), v)
    assert metrics.distance_error(metrics.k1_distances(lengths), plane(spark, [(x * metrics.CORRECTION**-1, y * metrics.CORRECTION**-1) for x, y, _ in QUAD])).first()["pct_error"] < 1e-9


def test_boundary_walks_equal_the_kernel(spark):
    own = [(0, 1, 2), (2, 3, 4), (10, 14, 11), (11, 14, 12), (12, 14, 13), (30, 32, 31), (40, 41, 42), (40, 41, 43), (40, 41, 44)]
    got = sorted((r["loop"], r["ord"], r["vid"]) for r in topology.boundary_paths(faces(spark, own)).collect())
    rim = graph.boundary(np.array(own))
    assert got == sorted((walk[0], i, v) for walk in graph.loops(rim[:, 0].tolist(), rim[:, 1].tolist()) for i, v in enumerate(walk))
    assert [v for loop, _, v in got if loop == 10] == [10, 11, 12, 13, 14] and topology.boundary_paths(faces(spark, own).limit(0)).count() == 0


def test_walk_of_a_long_boundary(spark):
    """A strip of 1,500 squares: 3,002 vertices on one loop, 12 rounds of ranking. With estimates of sizes that square in each round the planner didn't come to an end."""
    n = 1500
    f = spark.range(n).selectExpr("'s' subject", "'lh' hemi", f"explode(array(struct(2 * id fid, id a, id + 1 b, id + {n + 1} c), struct(2 * id + 1 fid, id + 1 a, id + {n + 2} b, id + {n + 1} c))) t").selectExpr("subject", "hemi", "t.*")
    assert [r["vid"] for r in topology.boundary_paths(f).orderBy("ord").collect()] == [*range(n + 1), *range(2 * n + 1, n, -1)]


def test_flips_with_and_without_zero_area(spark):
    f = faces(spark, [(0, 1, 2), (1, 2, 3), (0, 1, 1)])
    a = metrics.planar_areas(f, plane(spark, QUAD))
    assert metrics.flipped(a).first()["n_flipped"] == 1 and metrics.flipped(a, strict=False).first()["n_flipped"] == 2
    assert metrics.area_split(a).first()["negative"] == 0.5 and one(metrics.vertices_in_flipped(a)) == {1, 2, 3}


def test_components_and_sizes(spark):
    v, f = points(spark, TWO_QUADS), faces(spark, TWO_FACES)
    for parts in (topology.components(mesh.edges(f), v), topology.components_by_mesh(mesh.edges(f), v)):
        assert {(r["vid"], r["comp"]) for r in parts.collect()} == {(i, 0 if i < 4 else 4) for i in range(8)}
    sizes = topology.component_sizes(topology.components(mesh.edges(f), v)).collect()
    assert {(r["comp"], r["size"], r["rank"]) for r in sizes} == {(0, 4, 1), (4, 4, 2)}
    assert one(topology.drop_small_components(f, v)) == {0, 1, 2, 3}
    with pytest.raises(topology.TopologyError):
        topology.drop_small_components(f, v, large=3)
    with pytest.raises(topology.TopologyError):
        topology.check_disk(v, f)
    assert topology.check_disk(v, f, strict=False).count() == 1


def test_annulus_has_two_loops(spark):
    f = faces(spark, ANNULUS)
    assert {(r["loop"], r["vid"]) for r in topology.boundary_loops(f).collect()} == {(0, i) for i in range(4)} | {(4, i) for i in range(4, 8)}
    assert one(topology.longest_loop(f)) == {0, 1, 2, 3}
    assert one(topology.fill_holes(f, ids(spark, []))) and one(topology.hole_fill_round(f, ids(spark, []))) == {4, 5, 6, 7}


def test_patch_and_border(spark):
    grid = plain_grid(spark, 5)
    patch = mesh.build_patch(grid.vertices, grid.faces, grid.points.where("ix = 0").select("subject", "hemi", "vid"))
    got = {r["vid"]: (r["pid"], r["is_border"]) for r in patch.collect()}
    assert set(got) == {v for v in range(25) if v % 5} and {v for v, (_, b) in got.items() if b} == {v for v in range(25) if v % 5 == 1}
    assert [got[v][0] for v in sorted(got)] == list(range(20))
    assert mesh.patch_faces(grid.faces, patch).count() == 24
    tetra = faces(spark, [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])
    assert mesh.build_patch(points(spark, QUAD), tetra, ids(spark, [0, 1])).count() == 0
    v, f = mesh.drop_isolated(points(spark, [(0, 0, 0), (9, 9, 9), (1, 0, 0), (0, 1, 0)]), faces(spark, [(0, 2, 3)]))
    assert one(v) == {0, 1, 2} and [tuple(r)[3:] for r in f.collect()] == [(0, 1, 2)]


def test_removed_touching_degrees(spark):
    f = faces(spark, [(0, 1, 2), (2, 3, 4), (4, 5, 6)])
    full = points(spark, [(i, 0, 0) for i in range(10)])
    assert one(mesh.removed_vertices(full, f)) == {7, 8, 9}
    assert one(mesh.faces_touching(f, ids(spark, [2])), "fid") == {0, 1} and one(mesh.faces_without(f, ids(spark, [2])), "fid") == {2} and one(mesh.faces_within(f, ids(spark, [2, 3, 4])), "fid") == {1}
    edge = [(0, i) for i in (1, 2, 3, 4)] + [(5, i) for i in (6, 7, 8)] + [(9, 1)]
    adj = spark.createDataFrame([("s", "lh", a, b, 1.0) for x, y in edge for a, b in ((x, y), (y, x))], KEYED + "src long, dst long, w double")
    d = {r["vid"]: r["degree"] for r in mesh.degrees(adj, full).collect()}
    assert {v for v, n in d.items() if n > 2} == {0, 5} and {v for v, n in d.items() if n > 3} == {0}


def test_half_sphere(spark):
    m = half_sphere(spark, 12)
    assert m.vertices.count() == 145 and m.faces.count() == 12 + 2 * 12 * 11 and topology.euler(m.vertices, m.faces).first()["chi"] == 1
    n = {r["vid"]: r for r in metrics.vertex_normals(m.faces, m.vertices).collect()}
    p = {r["vid"]: r for r in m.vertices.collect()}
    assert all(abs(n[v]["nx"] * p[v]["x"] + n[v]["ny"] * p[v]["y"] + n[v]["nz"] * p[v]["z"]) > 0.9 * 50 for v in n)


def brute_distances(adj, source):
    best, todo = {source: 0.0}, [source]
    while todo:
        x = todo.pop(0)
        for y, w in adj[x]:
            if best[x] + w < best.get(y, math.inf) - 1e-12:
                best[y] = best[x] + w
                todo.append(y)
    return best


def test_rings_and_geodesics_leave_the_ring(spark):
    # a steep ridge: the shortest way inside the 2-ring isn't the shortest at all
    grid = plain_grid(spark, 9)
    steep = grid.vertices.selectExpr("subject", "hemi", "vid", "x", "y", "cast(if(vid % 9 = 4 and vid < 70, 30, 0) as double) as z")
    adj = mesh.mesh_graph(grid.faces, steep)
    near = graph.adjacency(*[np.array(x) for x in zip(*[(r["src"], r["dst"], r["w"]) for r in adj.collect()], strict=True)])
    got = {(r["src"], r["dst"]): (r["hop"], r["dist"]) for r in rings.geodesics(adj, 2).collect()}
    pairs = {(r["src"], r["dst"]): r["hop"] for r in rings.krings(adj, 2).collect()}
    assert {k: h for k, (h, _) in got.items()} == pairs
    assert all(abs(d * metrics.CORRECTION - brute_distances(near, s)[t]) < 1e-9 for (s, t), (_, d) in got.items())
    assert {(r["src"], r["dst"]): r["hop"] for r in rings.block_rings(adj, 2).collect()} == pairs
    walk = {(r["src"], r["dst"]): r["dist"] for r in rings.relaxed_distances(adj, rings.krings(adj, 2), 2).collect()}
    assert any(walk[k] > got[k][1] + 1e-9 for k in got)
    quad = mesh.mesh_graph(faces(spark, QUAD_FACES), points(spark, QUAD))
    d = {r["dst"]: r["dist"] * metrics.CORRECTION for r in rings.geodesics(quad, 2).where("src = 0").collect()}
    assert d == pytest.approx({1: 1.0, 2: 1.0, 3: 2.0})


def test_rings_of_a_mesh_of_several_shards(spark):
    """No task holds more than shards of bounded size; rings that reach over them are the same as by joins."""
    from meshql.operators import packs

    grid = plain_grid(spark, 80)
    adj = mesh.mesh_graph(grid.faces, grid.vertices).cache()
    sizes = [len(packs.load(r["uri"], r["at"], r["size"], 0).shard(r["block"]).ids) for r in packs.packed(adj).collect()]
    assert sum(sizes) == 6400 and len(sizes) > 3 and max(sizes) <= packs.BLOCK
    by_joins = {tuple(r) for r in rings.krings(adj, 3).select("src", "dst", "hop").collect()}
    found = rings.geodesics(adj, 3).collect()
    assert len(found) == len(by_joins) and {(r["src"], r["dst"], r["hop"]) for r in found} == by_joins
    assert all(r["dist"] == 1 / metrics.CORRECTION for r in found if abs(r["src"] - r["dst"]) in (1, 80))


def test_angular_samples(spark):
    rows = [("s", "lh", 0, i, 1, 2 * math.pi * i / 24) for i in range(24)] + [("s", "lh", 1, i, 1, 0.1 * i) for i in range(3)]
    got = rings.angular_samples(spark.createDataFrame(rows, KEYED + "src long, dst long, hop int, angle double"), 8).collect()
    assert {(r["dst"], r["slot"]) for r in got if r["src"] == 0} == {(3 * i, i) for i in range(8)}
    assert {r["dst"] for r in got if r["src"] == 1} == {0, 1, 2}


def problem(width=6, seed=0):
    r = np.random.default_rng(seed)
    xy = np.array([(i % width, i // width) for i in range(width * width)], dtype=float)
    tri = np.array([t for v in range(width * width) if v % width < width - 1 and v // width < width - 1 for t in ((v, v + 1, v + width), (v + 1, v + width + 1, v + width))])
    both = np.unique(np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1), axis=0)
    pairs = np.concatenate([both, both[:, ::-1]])
    rim = np.zeros(len(xy), dtype=bool)
    rim[graph.boundary(tri).ravel()] = True
    p = descent.Problem(len(xy), tri, pairs, np.linalg.norm(xy[pairs[:, 0]] - xy[pairs[:, 1]], axis=1), pairs, rim, float((width - 1) ** 2))
    return p, xy, xy + 0.8 * r.standard_normal(xy.shape)


def test_gradients_by_differences():
    p, _, uv = problem()
    g = p.gradients(uv)
    for k in range(2):
        for i in range(0, p.n, 5):
            for c in range(2):
                step = np.zeros_like(uv)
                step[i, c] = 1e-6
                slope = (p.energies(uv + step)[k] - p.energies(uv - step)[k]) / 2e-6
                assert abs(slope - g[k][i, c]) < 1e-3 * max(1, abs(slope))


def test_descent_lowers_energy_and_flips():
    from meshql.config import FinalNegativeAreaRemoval, FlattenConfig, NegativeAreaRemoval, Phase

    p, flat, uv = problem()
    config = FlattenConfig(phases=[Phase("a", 1.0, 1.0, [4, 1, 0], 20)], negative_area_removal=NegativeAreaRemoval(base_averages=4, iters_per_level=5), final_negative_area_removal=FinalNegativeAreaRemoval(enabled=False))
    shots = list(descent.flatten(p, uv, config))
    assert [s.step for s in shots] == list(range(1, len(shots) + 1)) and shots[-1].phase == "smoothing"
    own = [s for s in shots if s.phase == "a"]
    assert all(b.j_d + b.j_a <= a.j_d + a.j_a + 1e-9 for a, b in zip(own, own[1:], strict=False))
    assert shots[-1].n_flipped < shots[0].n_flipped and p.pct_error(shots[-1].uv) < p.pct_error(uv)
    assert p.n_flipped(flat) == 0 and np.allclose(p.rescaled(3 * flat).std(axis=0), flat.std(axis=0))


def test_grouped_flattening(spark):
    from meshql.config import FlattenConfig, KRing, Phase

    grid = plain_grid(spark, 6)
    wavy = grid.vertices.selectExpr("subject", "hemi", "vid", "x", "y", "0.3 * (vid % 3) as z").unionByName(grid.vertices.selectExpr("subject", "'rh' as hemi", "vid", "x", "y", "z"))
    tri = grid.faces.unionByName(grid.faces.selectExpr("subject", "'rh' as hemi", "fid", "a", "b", "c"))
    job = flatten.Flattener(FlattenConfig(kring=KRing(2, None), phases=[Phase("e", 1.0, 1.0, [1, 0], 10)]))
    with pytest.raises(RuntimeError):
        job.run()
    job.load(wavy, tri).compute_distances()
    shots = job.run(keep_every=3)
    ends = {(r["hemi"], r["step"]): r for r in shots.collect()}
    assert {h for h, _ in ends} == {"lh", "rh"} and all(len(r["uv"]) == 36 for r in ends.values())
    assert job.result().count() == 72
    m = {r["hemi"]: r for r in flatten.run_metrics(shots, job.kring, job.vertices).collect()}
    assert m["rh"]["flipped_final"] == 0 and m["rh"]["pct_error"] < 30


def test_backends():
    with pytest.raises(ValueError):
        flatten.backend("unknown")
    with pytest.raises(RuntimeError):
        flatten.backend("external")
    assert flatten.available() == ["numpy"] and "-seed" in flatten.ExternalBackend.command("a", "b", seed=3)
    calls = []

    def failing(uv, metadata):
        calls.append(metadata)
        raise KeyError

    call = flatten.notify(failing)
    call(None, {1: 1})
    call(None, {2: 2})
    assert calls == [{1: 1}]


def test_energy_tables_match_the_kernel(spark):
    p, xy, uv = problem()
    f, u = faces(spark, p.faces.tolist()), plane(spark, uv)
    kring = spark.createDataFrame([("s", "lh", int(a), int(b), 1, float(d)) for (a, b), d in zip(p.pairs, p.dist, strict=True)], KEYED + "src long, dst long, hop int, dist double")
    d, a = p.energies(uv)
    assert energy.metric_energy(kring, u).first()["j_d"] == pytest.approx(d) and energy.area_energy_softplus(metrics.planar_areas(f, u)).first()["j_a"] == pytest.approx(a)
    g_d, g_a = p.gradients(uv)
    got = {r["vid"]: (r["gu"], r["gv"]) for r in energy.weighted_gradient(kring, f, u, 0.5, 2.0).collect()}
    want = 0.5 * g_d / p.mean_pairs + 2.0 * g_a
    assert all(got[i] == pytest.approx(tuple(want[i]), abs=1e-9) for i in range(p.n))
    adj = spark.createDataFrame([("s", "lh", int(x), int(y), 1.0) for x, y in p.edges], KEYED + "src long, dst long, w double")
    after = {r["vid"]: (r["u"], r["v"]) for r in energy.spring_round(adj, u, f).collect()}
    kernel = descent.spring(p, uv, 1, 0.5, 1.0)
    assert all(after[i] == pytest.approx(tuple(kernel[i]), abs=1e-9) for i in range(p.n))
    steps = energy.line_search_energies(kring, f, u, energy.weighted_gradient(kring, f, u), [0.0, 0.5]).collect()
    assert {r["i"]: r["energy"] for r in steps}[0] == pytest.approx(d + a)


def grid_graph(n):
    adj = {v: [] for v in range(n * n)}
    for v in range(n * n):
        for w in ([v + 1] if v % n < n - 1 else []) + ([v + n] if v // n < n - 1 else []):
            adj[v].append((w, 1.0))
            adj[w].append((v, 1.0))
    return adj


def test_trapped():
    assert graph.trapped(grid_graph(20), set(range(21)), 20) == set()
    square = {0: [1, 3, 4], 1: [0, 2], 2: [1, 3], 3: [2, 0], 4: [0, 10], 10: [4]}
    assert graph.trapped({k: [(x, 1.0) for x in v] for k, v in square.items()}, {0, 1, 2, 3, 4}, 4) == {10}
    assert graph.trapped({0: [(1, 1.0)], 1: [(0, 1.0), (2, 1.0)], 2: [(1, 1.0)]}, {0, 1, 2}, 1) == set()


def test_paths_take_smaller_vertices():
    assert graph.paths(grid_graph(3), 0, {8})[8] == (4.0, [0, 1, 2, 5, 8])
    assert graph.paths({0: []}, 0, {5}) == {}


def test_cuts_become_continuous_and_reach_the_wall(spark):
    n = 12
    where = {v: np.array([v % n, v // n, 0.0]) for v in range(n * n)}
    adj = grid_graph(n)
    out = cut_kernel.continuous(adj, where, {1, 2, 5, 6, 9, 10})
    assert len(cut_kernel.parts(adj, out)) == 1 and {1, 2, 5, 6, 9, 10} <= out
    assert cut_kernel.continuous({0: [], 1: []}, where, {0, 1}) == {0, 1}
    wall = {v for v in range(n * n) if v // n >= 10}
    path = cut_kernel.refined(adj, where, [v for v in range(n * n) if v % n == 3 and v // n < 10], wall)
    assert path[0] == 3 and path[-1] // n == 9 and set(path).isdisjoint(wall)
    got = cut_kernel.absorb_regions(adj, where, {"temporal": [v for v in range(n * n) if v % n == 2]}, set(), set(where))
    assert {v for v in range(n * n) if v % n < 2} <= set(got["temporal"])


def test_merge_small():
    where = {i: np.array([float(i), 0, 0]) for i in range(200)}
    parts = [{0, 1, 2}, {20, 21}, {40, 41}, {60, 61}, {80, 81}, {3}, {99}]
    wall, mains = cut_kernel.merge_small(parts, {102}, {100, 101}, where)
    assert mains[0] == {0, 1, 2, 3} and wall == {99, 102} and len(mains) == 5
    assert cut_kernel.merge_small(parts[:3], set(), set(), where)[1][3:] == [set(), set()]


def test_cut_naming(spark):
    cuts_at = {1: (0, -50), 2: (-20, 0), 3: (-5, 5), 4: (5, 5), 5: (20, 0)}
    parts = spark.createDataFrame([("s", "lh", k, k) for k in cuts_at], KEYED + "vid long, part int")
    pts = points(spark, [(0, *cuts_at[k]) for k in cuts_at] + [(0, 0, 0)] * 3, [*cuts_at, 10, 11, 12])
    named = {r["part"]: r["name"] for r in template.name_cuts(parts, pts, pts.where("vid >= 10")).collect()}
    assert named == {1: "temporal", 2: "calcarine", 3: "medial1", 4: "medial2", 5: "medial3"}


def test_near_and_far(spark):
    a, b = points(spark, [(0, 0, 0), (5, 0, 0)]), points(spark, [(1, 0, 0), (9, 0, 0), (-1, 0, 0)], [7, 8, 9])
    assert {(r["vid"], r["near"], r["distance"]) for r in cuts.nearest(a, b).collect()} == {(0, 7, 1.0), (1, 7, 4.0)}
    assert tuple(cuts.set_distance(a, b).first())[2:] == (0, 7, 1.0) and tuple(cuts.farthest_pair(b).first())[2:] == (8, 9, 10.0)
    assert one(cuts.within(b, a, 1.5)) == {7, 9} and tuple(cuts.farthest_from(b, a.where("vid = 0")).first())[2:] == (8, 9.0)


def test_report_helpers(spark):
    with pytest.raises(ValueError):
        report.view_angles("lh", "top")
    with pytest.raises(ValueError):
        report.method_rings("slow", None, None)
    grid = plain_grid(spark, 3)
    seen = report.view_faces(grid.vertices, grid.faces, grid.points.select("subject", "hemi", "vid", "value"), grid.vertices.select("subject", "hemi", "vid"), "lh", "frontal")
    assert seen.count() in (0, 8)
    r = np.array(report.rotation(-90, 180))
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    log = report.area_distortion(metrics.planar_areas(grid.faces, grid.uv), metrics.face_areas_3d(grid.faces, grid.vertices)).collect()
    assert all(x["log2_ratio"] == 0 and x["level"] == 0.5 and not x["is_flipped"] for x in log)
    assert callable(signed_area)


def test_a_view_from_the_other_side_sums_depths_in_the_same_order(spark):
    p = points(spark, [(0.1, 0.3, 0.1), (1.2, 0.1, 0.7), (0.2, 1.1, 0.2)])
    f, value = faces(spark, [(0, 1, 2)]), p.selectExpr("subject", "hemi", "vid", "z - 0.4 value")
    turned = f.selectExpr("subject", "hemi", "fid", "a", "c b", "b c")
    there = [report.view_faces(p, own, value, p.select("subject", "hemi", "vid"), "lh", "ventral", turned_over=t).collect() for own, t in ((f, True), (turned, False), (f, False))]
    m = report.rotation(*report.view_angles("lh", "ventral"))[2]
    mid = [(0.1 + 1.2 + 0.2) / 3, (0.3 + 0.1 + 1.1) / 3, (0.1 + 0.7 + 0.2) / 3]
    assert there[0][0]["depth"] == m[0] * mid[0] + m[1] * mid[1] + m[2] * mid[2] and there[0][0]["shade"] == there[1][0]["shade"] and not there[2]


def test_energy_changes_below_zero(spark):
    shots = spark.createDataFrame([("s", "lh", i, "p", e, 0.0, 3) for i, e in enumerate([2.0, -1.0, -3.0, 0.0, 4.0])], "subject string, hemi string, step int, phase string, j_d double, j_a double, n_flipped int")
    assert [r["rel_change"] for r in snapshots.energy_changes(shots).orderBy("step").collect()] == [None, 1.5, -2.0, 1.0, None]


def test_snapshot_sampling_equals_numpy(spark):
    for n in (1, 7, 30, 57, 100):
        rows = [("s", "lh", i + 1, "p", [(0.0, 0.0)]) for i in range(n)]
        df = spark.createDataFrame(rows, KEYED + "step int, phase string, uv array<struct<u:double,v:double>>")
        for k in (1, 2, 10, 25):
            want = {i + 1 for i in (range(n) if n <= k else np.unique(np.round(np.linspace(0, n - 1, k)).astype(int)))}
            assert one(snapshots.sampled(df, k), "step") == want, (n, k)
    with pytest.raises(ValueError):
        snapshots.check(df.drop("uv"))


class Options:
    n_coarse_steps, max_mm, min_mm = 5, 1000.0, 0.001


def test_search_bounds_on_worked_numbers():
    # amounts 0.6, 0, 0, 0.8: the largest is 0.8, the mean 0.35
    low, top = descent.search_bounds(np.array([[0.6, 0.0], [0.0, -0.8]]), Options)
    assert top == pytest.approx(1250.0) and low == pytest.approx(0.001 / 0.35)
    # a mean far under the largest amount: the smallest step is a thousandth of the largest one
    spread = np.zeros((100_000, 2))
    spread[0, 0] = 1.0
    assert descent.search_bounds(spread, Options) == (pytest.approx(1.0), pytest.approx(1000.0))


def test_line_matches_plain_energies():
    p, flat, uv = problem()
    way = flat - uv
    for (d, a), s in zip(descent.Line(p, uv, way).at([0.0, 0.3, 1.0]), [0.0, 0.3, 1.0], strict=True):
        x = uv + s * way
        length = np.sqrt(((x[p.pairs[:, 1]] - x[p.pairs[:, 0]]) ** 2).sum(axis=1) + 1e-12)
        area = np.clip(p.areas(x), -40, 40)
        assert d == pytest.approx(((length - p.dist) ** 2).sum(), abs=1e-9) and a == pytest.approx((np.logaddexp(0, 10 * area) / 10 - area).sum())


def test_threads_change_nothing():
    from meshql.config import FlattenConfig, Phase

    config, found = FlattenConfig(phases=[Phase("a", 1.0, 1.0, [4, 0], 5)]), []
    for threads in (1, 3):
        p, _, uv = problem(9)
        q = descent.Problem(p.n, p.faces, p.pairs, p.dist, p.edges, p.boundary, p.area, threads)
        q.blocks = [(a, min(a + 10, q.n)) for a in range(0, q.n, 10)]
        found.append(list(descent.flatten(q, uv, config))[-1].uv)
    assert np.array_equal(*found)


def test_smoothing_beyond_the_padded_columns():
    rim = [(0, i) for i in range(1, 13)] + [(i, 1 + i % 12) for i in range(1, 13)]
    edges = np.array(rim + [(b, a) for a, b in rim])
    tri = np.array([(0, i, 1 + i % 12) for i in range(1, 13)])
    p = descent.Problem(13, tri, edges, np.ones(len(edges)), edges, np.zeros(13, dtype=bool), 1.0)
    g = np.random.default_rng(1).standard_normal((13, 2))
    want = g
    for _ in range(3):
        total = want.copy()
        np.add.at(total, edges[:, 0], want[edges[:, 1]])
        want = total / (np.bincount(edges[:, 0], minlength=13) + 1)[:, None]
    assert np.allclose(p.smooth(g, 3), want)


def test_a_level_compares_from_its_second_step():
    from meshql.config import FlattenConfig

    # the tolerance stops a level as soon as it may compare, which is after two steps
    p, _, uv = problem()
    assert [i for i, _ in descent.descend(p, uv, [0], 9, 1e9, 1.0, 1.0, FlattenConfig())] == [1, 2]


def test_rescaling_precedes_the_step():
    from meshql.config import FlattenConfig

    p, flat, _ = problem()
    (_, move), *_ = descent.descend(p, 3 * flat, [0], 1, 0.1, 1.0, 1.0, FlattenConfig(), rescale=True)
    # at the true scale nothing is to be done, so the step that follows moves next to nothing
    assert np.allclose(move.uv - move.uv.mean(axis=0), flat - flat.mean(axis=0), atol=0.05)


def test_recovery_turns_a_planted_fold_back(monkeypatch):
    from meshql.config import FlattenConfig, Phase

    p, flat, _ = problem(8)
    folded = flat.copy()
    folded[(flat > 2).all(axis=1) & (flat < 5).all(axis=1)] += 3.0
    n = p.n_flipped(folded)
    assert n > 5 and p.n_flipped(descent.recover(p, folded, 4, Options)) < n
    monkeypatch.setattr(descent, "RECOVER_LEAST", 5)
    watch = descent.Recovery(p, flat, FlattenConfig())
    assert watch(flat, 4) is flat
    back = watch(folded, 4)
    assert p.n_flipped(back) < n and watch.left == descent.RECOVERIES - 1 and watch.limit == max(5 * p.n_flipped(back), 5)
    assert watch.end(folded) is flat and watch.end(flat) is flat
    seen, phase = [], Phase("epoch_3", 0.1, 1.0, [4, 1], 3)
    monkeypatch.setattr(descent, "recover", lambda p, uv, level, options: seen.append(level) or flat)
    monkeypatch.setattr(descent.Recovery, "__init__", lambda self, p, uv, config: self.__dict__.update(p=p, options=None, best=(10**6, uv), limit=0, left=3))
    list(descent.run_phase(p, folded, phase, FlattenConfig(adaptive_recovery=True)))
    assert seen and seen[0] == 4  # at the level that ran


def test_recovery_weight():
    assert descent.adaptive_weight(0.5, 300.0, 2.0) == 75.0


def test_block_sampling_is_that_of_the_tables(spark):
    grid = plain_grid(spark, 11)
    wavy = grid.vertices.selectExpr("subject", "hemi", "3 * vid + 5 as vid", "x + 0.1 * ((vid * 7919) % 13) / 13 as x", "y + 0.1 * ((vid * 104729) % 17) / 17 as y", "0.2 * ((vid * 31) % 7) as z")
    tri = grid.faces.selectExpr("subject", "hemi", "fid", "3 * a + 5 as a", "3 * b + 5 as b", "3 * c + 5 as c")
    adj, normals = mesh.mesh_graph(tri, wavy), metrics.vertex_normals(tri, wavy)
    by_tables = rings.angular_samples(rings.tangent_positions(rings.geodesics(adj, 4), wavy, normals), 6)
    want = {(r["src"], r["dst"]): (r["hop"], r["slot"], round(r["dist"], 9)) for r in by_tables.collect()}
    got = {(r["src"], r["dst"]): (r["hop"], r["slot"], round(r["dist"], 9)) for r in rings.sampled_rings(adj, wavy, normals, 4, 6).collect()}
    assert got == want and len(got) > 1000


def test_empty_mesh_has_no_rings(spark):
    adj = spark.createDataFrame([], KEYED + "src long, dst long, w double")
    assert rings.geodesics(adj, 2).count() == 0 and rings.block_rings(adj, 2).count() == 0


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_plans_grow_linearly_with_rounds(spark):
    grid = plain_grid(spark, 5)
    adj, g = mesh.mesh_graph(grid.faces, grid.vertices), grid.uv.withColumnsRenamed({"u": "gu", "v": "gv"})
    two, four, six = (scans(energy.smooth(g, adj, n)) for n in (2, 4, 6))
    assert six - four == four - two <= 4
    assert scans(energy.smooth(g, adj, 40)) <= scans(energy.smooth(g, adj, energy.CUT_ROUNDS))
    pairs = rings.krings(adj, 2)
    two, four, six = (scans(rings.relaxed_distances(adj, pairs, n)) for n in (2, 4, 6))
    assert six - four == four - two <= 4
    assert scans(rings.krings(adj, 5)) - scans(rings.krings(adj, 4)) <= 4


def test_exact_percentiles(spark):
    values = [float(x) for x in np.random.default_rng(3).standard_normal(997).round(1)]
    got = report.exact_percentiles(spark.createDataFrame([(x,) for x in values] + [(None,)], "a double").repartition(7), "a", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).first()
    assert [got["p1"], got["p50"], got["p99"]] == pytest.approx(list(np.percentile(values, [1, 50, 99])))
    assert report.exact_percentiles(spark.createDataFrame([], "a double"), "a", {"p1": 0.01}).first()["p1"] is None


def test_entry_survives_a_missing_library():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = sys.modules['regex'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 90


def test_cuts_read_a_mesh_of_several_shards(spark):
    m = plain_grid(spark, 60)
    assert len(where := {v: np.array([v % 60, v // 60, 0.0]) for v in range(60 * 60)}) > packs.BLOCK
    adj = mesh.mesh_graph(m.faces, m.vertices)
    e = adj.toPandas()
    near = graph.adjacency(e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy())
    row = [v for v in range(60 * 60) if v // 60 == 35 and v % 6 < 4 and v % 60 < 32]
    wall = {v for v in range(60 * 60) if v % 60 >= 35}

    def table(ids, name="calcarine"):
        return spark.createDataFrame([("grid", "lh", name, v, i) for i, v in enumerate(ids)], cuts.CUTS)

    def got(df):
        return [r["vid"] for r in df.orderBy("ord").collect()]

    assert got(cuts.continuous(adj, m.vertices, table(row))) == sorted(cut_kernel.continuous(near, where, set(row)))
    walls = table(wall).select("subject", "hemi", "vid")
    made = {"calcarine": cut_kernel.refined(near, where, row, wall)}
    assert got(cuts.refine(adj, m.vertices, table(row), walls)) == cut_kernel.absorb_regions(near, where, made, wall, set(where))["calcarine"]
    pairs = spark.createDataFrame([("grid", "lh", 3, 2900), ("none", "lh", 7, 7)], "subject string, hemi string, src long, dst long")
    found = {r["ord"]: (r["vid"], r["length"]) for r in cuts.shortest_paths(adj, pairs).where("subject = 'grid'").collect()}
    length, walk = graph.paths(near, 3, {2900})[2900]
    assert [found[i][0] for i in range(len(walk))] == walk and found[0][1] == length
    shut = [v for v in where if v % 60 + v // 60 in (5, 6)]
    assert sorted(got(cuts.trapped(adj, m.vertices, table(shut).select("subject", "hemi", "vid"), 0).withColumn("ord", F.lit(0)))) == sorted(graph.trapped(near, set(shut), 0))


def test_components_by_ranges_equal_those_by_joins(spark):
    rng = np.random.default_rng(5)
    rows = [(s, h, int(a), int(a + d)) for s in ("a", "b") for h in ("lh", "rh") for a, d in zip(rng.integers(0, 300, 180), rng.integers(1, 40, 180), strict=True)]
    e = spark.createDataFrame(rows, "subject string, hemi string, u long, v long")
    v = spark.createDataFrame([(s, h, i) for s in ("a", "b", "c") for h in ("lh", "rh") for i in range(350)], "subject string, hemi string, vid long")
    both = [{tuple(r) for r in f(e, v).select("subject", "hemi", "vid", "comp").collect()} for f in (topology.components, topology.components_by_ranges)]
    assert both[0] == both[1] and len(both[0]) == 6 * 350


def test_regions_go_to_the_nearest_of_several_cuts(spark):
    m, near = plain_grid(spark, 10), grid_graph(10)  # parts are the same with the cells' diagonals
    where = {v: np.array([v % 10, v // 10, 0.0]) for v in range(100)}
    own = {"temporal": [v for v in where if v % 10 == 2], "medial1": [v for v in where if v % 10 == 7]}
    table = spark.createDataFrame([("grid", "lh", n, v, i) for n, c in own.items() for i, v in enumerate(c)], cuts.CUTS)
    found = cuts.absorb(mesh.mesh_graph(m.faces, m.vertices), m.vertices, table, table.select("subject", "hemi", "vid").limit(0))
    assert {(r["name"], r["vid"]) for r in found.collect()} == {(n, v) for n, c in cut_kernel.absorb_regions(near, where, own, set(), set(where)).items() for v in c}


def test_numbers_and_holds_by_runs(spark, monkeypatch):
    rows = [("s", h, i * (1 + (h == "rh")), "ab"[i // 20 % 2] if i % 13 else "") for h in ("lh", "rh") for i in range(3, 90)]
    df = spark.createDataFrame(rows, "subject string, hemi string, step int, phase string")
    out = []
    for size in (1000, 7):
        monkeypatch.setattr(mesh, "NUMBERED", size)
        held = snapshots.with_holds(df, 10.0, 1.0, 0.3, 2.0)
        assert held.schema.simpleString() == "struct<subject:string,hemi:string,step:int,phase:string,frame_idx:int>"
        out.append(sorted(tuple(r) for r in held.collect()))
        assert sorted(r["n"] for r in mesh.numbered(df, "step", "n").where("hemi = 'rh'").collect()) == list(range(87))
    assert out[0] == out[1]
    times = {}
    for r in out[0]:
        times[r[:3]] = times.get(r[:3], 0) + 1
    assert times[("s", "lh", 3)] == 11 and times[("s", "rh", 178)] == 21
    assert sorted(r[4] for r in out[0] if r[1] == "lh") == list(range(sum(n for k, n in times.items() if k[1] == "lh")))


def test_area_energies_join_each_corner_once(spark):
    m = table_mesh(spark, "/root/testdata/sf0.001", "customer") if os.path.isdir("/root/testdata/sf0.001") else plain_grid(spark, 8)
    both = metrics.both_areas(m.faces, m.points)
    apart = metrics.planar_areas(m.faces, m.uv), metrics.face_areas_3d(m.faces, m.vertices)
    for f in (energy.area_energy_sigmoid, energy.area_energy_barrier):
        assert math.isclose(f(both).first()["j_a"], f(*apart).first()["j_a"], rel_tol=1e-12)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def joins(df):
    """Joins in the plan of df."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_an_edge_is_joined_once_with_either_end(spark):
    """Space and plane come with the same two joins, and both directions of an edge are made after them."""
    m = plain_grid(spark, 6)
    pairs = metrics.k1_in_plane(m.faces, m.points)
    assert joins(metrics.distance_error(pairs, m.uv)) == joins(energy.metric_energy(pairs, m.uv)) == 2
    assert joins(report.points_report(m.points, m.faces)) <= 6  # three corners, two ends, the two rows
    plain = metrics.k1_distances(mesh.edge_lengths(mesh.edges(m.faces), m.vertices))
    assert sorted(map(tuple, pairs.select("src", "dst", "hop", "dist").collect())) == sorted(map(tuple, plain.select("src", "dst", "hop", "dist").collect()))
    assert metrics.distance_error(pairs, m.uv).first()["pct_error"] == pytest.approx(metrics.distance_error(plain, m.uv).first()["pct_error"], rel=1e-12)
    assert sorted(map(tuple, mesh.neighbour_pairs(m.faces).select("src", "dst").collect())) == sorted(map(tuple, plain.select("src", "dst").collect()))


def test_walks_longer_than_the_farthest_target_end(spark, monkeypatch):
    """A detour of more edges than the ring has hops is found, and no table of walks grows beyond the pairs that were reached at first."""
    heavy = [("s", "lh", a, b, 1.0) for a in range(12) for b in (a - 1, a + 1) if 0 <= b < 12] + [("s", "lh", 0, 4, 10.0), ("s", "lh", 4, 0, 10.0)]
    adj = spark.createDataFrame(heavy, KEYED + "src long, dst long, w double")
    sizes, settled = [], rings.settled
    monkeypatch.setattr(rings, "settled", lambda df: sizes.append(settled(df)) or sizes[-1])
    found = {(r["src"], r["dst"]): r["dist"] * metrics.CORRECTION for r in rings.relaxed_distances(adj, rings.krings(adj, 1), 6).collect()}
    assert found[0, 4] == pytest.approx(4) and found[0, 1] == pytest.approx(1) and len(found) == len(heavy)
    walks = [df.count() for df in sizes if "far" in df.columns]
    assert walks and max(walks) < len(heavy)

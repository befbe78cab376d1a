"""The report's job writes rows of meshes between its steps, not of their faces, edges or pairs."""

from jobs import hemisphere_report
from meshql.operators import batch, mesh, metrics, report
from meshql.plans import population
from meshql.schema import KEY

from .test_jobs import by_sql, orders, rows_of


def test_only_meshes_are_written_between_the_steps(spark, tmp_path, monkeypatch):
    data, out, sizes, table = str(tmp_path / "orders"), str(tmp_path / "out"), [], hemisphere_report.settled
    orders(spark, 1100).write.parquet(data)
    monkeypatch.setattr(hemisphere_report, "settled", lambda df: sizes.append((own := table(df)).count()) or own)
    assert hemisphere_report.run(spark, data, out)["fresh"] == 5
    assert rows_of(hemisphere_report.result(spark, out)) == by_sql(hemisphere_report.SQL, orders=data)
    assert len(sizes) >= 4 and max(sizes) == 5


def test_sums_equal_the_single_operators(spark):
    m = population.hemispheres(orders(spark, 700), 16)
    error, ring = batch.validate(m.vertices, m.faces), metrics.k1_in_plane(m.faces, m.points)
    sums = {tuple(r[c] for c in KEY): r for r in report.face_sums(m.points, m.faces).join(metrics.ring_errors(ring, m.points), KEY).collect()}
    worst = metrics.vertex_distortion(ring, m.uv).groupBy(*KEY).agg({"distortion": "max"}).withColumnRenamed("max(distortion)", "worst_distortion")
    whole = report.points_report(m.points, m.faces).join(worst, KEY).join(error.select(*KEY, "area"), KEY).collect()
    assert len(whole) == len(sums) == 3
    for r in whole:
        own = sums[tuple(r[c] for c in KEY)]
        assert own["n_flipped"] == r["n_flipped"] and all(abs(own[c] - r[c]) <= 1e-9 * (1 + abs(r[c])) for c in ("area", "area_2d_pos", "area_2d_neg", "pct_error", "worst_distortion"))
    rim = mesh.edges(m.faces).where("n_faces = 1").groupBy(*KEY).count().join(error, KEY).collect()
    assert len(rim) == 3 and all(r["count"] == 2 * r["n_edges"] - 3 * r["n_faces"] for r in rim)

"""Quality report of a growing collection of hemispheres: every mesh that is new, or has changed, is checked and measured, and gets a status row.

The high-water mark is a table of content marks (subject, hemi, fingerprint) beside the report. A run reads the whole input once for the marks, measures the meshes whose mark isn't
there, and writes the blocks of subjects that they are in anew (dynamic partition overwrite), first of the report, then of the marks. A run that ends between the two measures
the same meshes again and writes the same rows. Meshes that have left the input stay in the report.

    python -m jobs.hemisphere_report --orders DIR/orders.parquet --output DIR/report
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshql.operators import batch, mesh, metrics, report
from meshql.operators.checkpoints import kept, settled
from meshql.plans import population
from meshql.plans.batches import CHECKED
from meshql.schema import KEY

from . import common

log = logging.getLogger("hemisphere_report")
REPORT = (
    "subject string, hemi string, status string, error string, n_vertices long, n_used long, n_edges long, n_faces long, chi long, n_rim long, area_3d double, "
    "area_2d_pos double, area_2d_neg double, n_flipped long, pct_error double, worst_distortion double, half double, block int"
)
MARKS = "subject string, hemi string, fingerprint string, block int"
COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
MEASURES = COLUMNS[COLUMNS.index("n_rim") : COLUMNS.index("block")]


def block_of(subject: str, size: int):  # noqa: ANN201
    """Number of the run of `size` subjects that a subject is in; the subject's digits are its number."""
    return F.floor(F.regexp_extract(subject, r"(\d+)$", 1).cast("long") / size).cast("int")


def measure(points: DataFrame, faces: DataFrame, digits: int) -> DataFrame:
    """A report row for each mesh; measures are null where the check found an error.

    Corners are joined once for all that faces tell, and edges once for both errors of distance; no table of faces, edges or pairs is written.
    """
    sums = settled(report.face_sums(points, faces))
    checked = settled(batch.validate(points.select(*KEY, "vid", "x", "y", "z"), faces, sums.select(*KEY, "area")))
    bad = checked.where("error is not null").select(*KEY)
    tri = faces.join(mesh.each(bad, bad.count()), KEY, "left_anti")
    errors = metrics.ring_errors(metrics.k1_in_plane(tri, points), points)
    # no edge has more than two faces where the check was passed, so that those of one follow from the counts
    rim = 2 * F.col("n_edges") - 3 * F.col("n_faces")
    out = checked.withColumn("n_rim", F.when(rim > 0, rim)).withColumnRenamed("area", "area_3d").join(sums.drop("area"), KEY, "left").join(errors, KEY, "left")
    out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in MEASURES}).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    return out.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes if c in COLUMNS])


def run(spark: SparkSession, orders: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Bring the report under `output` up to the table at `orders`. Returns how many meshes were read, new or changed, and how many rows the written blocks have."""
    config = config or common.config_of(__file__)
    size = config["subjects_per_block"]
    m = population.hemispheres(spark.read.parquet(orders), config["side"])
    marks = settled(batch.fingerprints(m.points, m.faces).withColumn("block", block_of("subject", size)).select(*KEY, "fingerprint", "block"))
    known = common.table_or_none(spark, f"{output}/marks", MARKS)
    fresh = settled(marks if known is None else marks.join(known, [*KEY, "fingerprint"], "left_anti").select(*marks.columns))
    counts = {"read": marks.count(), "fresh": fresh.count(), "written": 0}
    log.info("read %s: %d hemispheres, %d of them new or changed", orders, counts["read"], counts["fresh"])
    if not counts["fresh"]:
        return counts
    points, faces = m.points, m.faces
    if counts["fresh"] < counts["read"]:
        points, faces = (kept(df.join(fresh.select(*KEY), KEY, "left_semi")) for df in (points, faces))
    rows = measure(points, faces, config["digits"])
    touched = fresh.select("block").distinct()
    for name, schema, own in (("report", REPORT, rows.withColumn("block", block_of("subject", size))), ("marks", MARKS, fresh)):
        there = common.table_or_none(spark, f"{output}/{name}", schema)
        own = own.select(*[c.split()[0] for c in schema.split(", ")])
        if there is not None:  # the other hemispheres of the blocks that are written anew
            own = own.unionByName(there.join(touched, "block", "left_semi").join(fresh.select(*KEY), KEY, "left_anti"))
        own = settled(own)
        own.repartition("block").sortWithinPartitions(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{output}/{name}")
        n = own.count()
        counts["written"] = counts["written"] or n
        log.info("wrote %s/%s: %d rows in %d blocks", output, name, n, touched.count())
    return counts


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output}/report")


#: The report by DuckDB, with the options of the config file beside this module.
SQL = (
    population.population_sql(16)
    + CHECKED
    + f""", rims AS (SELECT g, count(*) AS n_rim FROM e WHERE n_faces = 1 GROUP BY g),
k1 AS (SELECT adj.g, src, adj.w / {metrics.CORRECTION!r} AS dist, sqrt((q.u - o.u) * (q.u - o.u) + (q.v - o.v) * (q.v - o.v)) AS flat FROM adj JOIN p o ON o.vid = src JOIN p q ON q.vid = dst),
err AS (SELECT g, 100 * sum(abs(flat - dist)) / sum(dist) AS pct_error FROM k1 WHERE dist > 0 GROUP BY g),
worst AS (SELECT g, max(d) AS worst_distortion FROM (SELECT g, src, 100 * avg(abs(flat - dist)) / avg(dist) AS d FROM k1 WHERE dist > 0 GROUP BY g, src) GROUP BY g),
areas AS (SELECT g, coalesce(sum(area2) FILTER (area2 > 0), 0) AS pos, coalesce(-sum(area2) FILTER (area2 < 0), 0) AS neg, count(*) FILTER (area2 < 0) AS n_flipped FROM fa GROUP BY g),
box AS (SELECT p.g, greatest(max(u) - min(u), max(v) - min(v)) / 2 AS half FROM p JOIN used ON used.vid = p.vid GROUP BY p.g)
SELECT subject, hemi, 'ok' AS status, error, n_vertices, n_used, n_edges, n_faces, chi, n_rim, round(area, 6) AS area_3d, round(pos, 6) AS area_2d_pos, round(neg, 6) AS area_2d_neg, n_flipped,
       round(pct_error, 6) AS pct_error, round(worst_distortion, 6) AS worst_distortion, round(half, 6) AS half, CAST(g // 16 AS INTEGER) AS block
FROM chk JOIN rims USING (g) JOIN err USING (g) JOIN worst USING (g) JOIN areas USING (g) JOIN box USING (g) WHERE error IS NULL
UNION ALL SELECT subject, hemi, 'error', error, n_vertices, n_used, n_edges, n_faces, chi, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(g // 16 AS INTEGER) FROM chk WHERE error IS NOT NULL"""
)


def main(argv: list[str] | None = None) -> int:
    return common.command("hemisphere_report", {"orders": "Parquet table of vertices", "output": "folder of the report and its marks"}, lambda spark, args: run(spark, args.orders, args.output, common.config_of(__file__, args.config)), argv)


if __name__ == "__main__":
    sys.exit(main())

"""The jobs over input that grows (on copies), runs that end half-way, command lines."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import common, hemisphere_report, queries, run_telemetry
from meshql.plans import batches
from meshql.streaming import telemetry

from . import oracle

REPO = Path(__file__).parents[1]


def orders(spark, n, changed=()):
    return spark.range(n).selectExpr("id as o_orderkey", f"id * 31 % 500 + case when id in ({','.join(map(str, changed or (-1,)))}) then 1 else 0 end as o_custkey", "cast(1000 + id % 77 as double) as o_totalprice")


def by_sql(sql, **views):
    c = duckdb.connect()
    for name, path in views.items():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    r = c.sql(sql)
    return oracle.rows(r.columns, r.fetchall())


def rows_of(df):
    return oracle.rows(df.columns, df.collect())


def test_report_takes_what_is_new_or_changed(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    data, out = str(tmp_path / "orders"), str(tmp_path / "out")
    settings = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    orders(spark, 1100).write.parquet(data)  # four meshes and a part of a fifth
    assert hemisphere_report.run(spark, data, out) == {"read": 5, "fresh": 5, "written": 5}
    assert rows_of(hemisphere_report.result(spark, out)) == by_sql(hemisphere_report.SQL, orders=data)
    assert hemisphere_report.run(spark, data, out) == {"read": 5, "fresh": 0, "written": 0}
    before = rows_of(hemisphere_report.result(spark, out))
    # the fifth is completed, four more come, and a vertex of the second moves
    orders(spark, 2300, changed=(300,)).write.mode("overwrite").parquet(data)
    assert hemisphere_report.run(spark, data, out, hemisphere_report.common.config_of(hemisphere_report.__file__)) == {"read": 9, "fresh": 6, "written": 9}
    after = rows_of(hemisphere_report.result(spark, out))
    assert after == by_sql(hemisphere_report.SQL, orders=data) != before
    assert "9 hemispheres, 6 of them new or changed" in caplog.text and "wrote" in caplog.text
    assert settings is None or settings == dict(spark.conf.getAll)


def test_report_leaves_other_blocks_alone(spark, tmp_path):
    data, out, config = str(tmp_path / "orders"), str(tmp_path / "out"), {"side": 8, "subjects_per_block": 2, "digits": 6}
    orders(spark, 64 * 7).write.parquet(data)
    assert hemisphere_report.run(spark, data, out, config) == {"read": 7, "fresh": 7, "written": 7}
    blocks = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "out" / "report").glob("block=*")}
    orders(spark, 64 * 9).write.mode("overwrite").parquet(data)
    assert hemisphere_report.run(spark, data, out, config) == {"read": 9, "fresh": 2, "written": 5}  # block 1 has three old meshes
    now = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "out" / "report").glob("block=*")}
    assert now["block=0"] == blocks["block=0"] and now["block=1"] != blocks["block=1"] and len(now) == 3
    assert hemisphere_report.result(spark, out).count() == 9


def test_report_that_ended_before_its_marks(spark, tmp_path):
    data, out = str(tmp_path / "orders"), tmp_path / "out"
    orders(spark, 700).write.parquet(data)
    hemisphere_report.run(spark, data, str(out))
    before = rows_of(hemisphere_report.result(spark, str(out)))
    (out / "marks").rename(tmp_path / "lost")
    assert hemisphere_report.run(spark, data, str(out))["fresh"] == 3
    assert rows_of(hemisphere_report.result(spark, str(out))) == before


def test_report_of_no_rows(spark, tmp_path):
    data = str(tmp_path / "orders")
    orders(spark, 0).write.parquet(data)
    assert hemisphere_report.run(spark, data, str(tmp_path / "out")) == {"read": 0, "fresh": 0, "written": 0}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def add_events(spark, folder, first, last):
    rows = spark.range(first, last).selectExpr(
        "id as event_id", "timestamp_ntz '2024-03-01 22:00:00' + make_dt_interval(0, 0, cast(id * 37 % 600 as int)) as ts", "case when id % 3 = 0 then 0 else id % 11 end as user_id", "case when id % 5 = 0 then 'error' else 'step' end as event_type",
        "cast(id * 17 % 23 as double) - 3 as value", "concat('{\"k\": ', id % 9, '}') as props",
    )
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_telemetry_takes_new_files_only(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    data, out, state = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "state")
    add_events(spark, data, 0, 400)
    assert run_telemetry.run(spark, data, out, state) == 400
    assert rows_of(run_telemetry.result(spark, out)) == by_sql(run_telemetry.SQL, events=data)
    assert run_telemetry.run(spark, data, out, state) == 0
    for a in (400, 700, 1000):
        add_events(spark, data, a, a + 300)
    assert run_telemetry.run(spark, data, out, state, {"files_per_batch": 2}) == 900
    found = rows_of(run_telemetry.result(spark, out))
    assert found == by_sql(run_telemetry.SQL, events=data) and len(found[1]) > 15
    assert [caplog.text.count(f"read {n} events") for n in (400, 600, 300)] == [1, 1, 1] and "900 new events in 2 batches" in caplog.text
    assert run_telemetry.run(spark, data, out, state) == 0 and rows_of(run_telemetry.result(spark, out)) == found


def test_telemetry_that_ended_half_way(spark, tmp_path, monkeypatch):
    """The batch's partial rows are written, its days aren't; the next run repeats the batch and counts nothing twice."""
    data, out, state = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "state")
    add_events(spark, data, 0, 300)
    run_telemetry.run(spark, data, out, state)
    add_events(spark, data, 300, 500)
    with monkeypatch.context() as m:
        m.setattr(telemetry, "day_rows", lambda partials: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            run_telemetry.run(spark, data, out, state)
    assert run_telemetry.run(spark, data, out, state) == 200
    assert rows_of(run_telemetry.result(spark, out)) == by_sql(run_telemetry.SQL, events=data)


def test_telemetry_of_odd_events(spark, tmp_path):
    data = str(tmp_path / "events")
    rows = [(1, None, 5, None, 2.0, None), (2, None, None, "error", float("nan"), "no json"), (3, None, 5, "error", None, '{"k": "x"}'), (3, None, 5, "error", 1.0, '{"k": 4}')]
    spark.createDataFrame(rows, EVENTS).write.parquet(data)
    assert run_telemetry.run(spark, data, str(tmp_path / "out"), str(tmp_path / "state")) == 4
    found = {r["run"]: r for r in run_telemetry.result(spark, str(tmp_path / "out")).collect()}
    assert found[5].asDict() == {"run": 5, "n": 3, "n_errors": 2, "k_total": 4, "best_value": 1.0, "best_event": 3, "first_event": None, "last_event": None, "first_value": None, "last_value": None, "rel_change": None, "day": None}
    assert found[None]["n"] == 1 and found[None]["best_value"] is None and found[None]["n_errors"] == 1


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], oracle.connection())


def test_config(tmp_path):
    assert common.config_of(hemisphere_report.__file__) == {"side": 16, "subjects_per_block": 8, "digits": 6} and batches.SIDE == 16
    (tmp_path / "own.json").write_text(json.dumps({"files_per_batch": 3}))
    assert common.config_of(run_telemetry.__file__, str(tmp_path / "own.json")) == {"files_per_batch": 3}
    (tmp_path / "odd.json").write_text(json.dumps({"files": 3}))
    with pytest.raises(ValueError, match="unknown options: files"):
        common.config_of(run_telemetry.__file__, str(tmp_path / "odd.json"))


def test_command_lines(spark, tmp_path):
    orders(spark, 300).write.parquet(str(tmp_path / "orders"))
    add_events(spark, str(tmp_path / "events"), 0, 50)
    env = os.environ | {"PYTHONPATH": str(REPO), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    for args in (
        ["jobs.hemisphere_report", "--orders", tmp_path / "orders", "--output", tmp_path / "report"],
        ["jobs.run_telemetry", "--events", tmp_path / "events", "--output", tmp_path / "out", "--checkpoint", tmp_path / "state"],
    ):
        done = subprocess.run([sys.executable, "-m", *map(str, args)], env=env, cwd=REPO, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and " read " in done.stderr and " wrote " in done.stderr, done.stderr[-2000:]
    assert hemisphere_report.result(spark, str(tmp_path / "report")).count() == 2 and run_telemetry.result(spark, str(tmp_path / "out")).count() > 0

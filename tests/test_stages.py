"""Stage tables, notes and signals from memory."""

import numpy as np

from pulsegrid.operators import signal as G
from pulsegrid.sources import stages


def test_stage_tables_are_replaced_by_recording(spark, tmp_path):
    folder = str(tmp_path)
    make = lambda rows: spark.createDataFrame(rows, "rec_id string, start long, stop long")
    stages.write_stage(make([("a", 1, 2), ("b", 3, 4), ("b", 5, 6)]), folder, "bursts", {"max_gap": 2_500_000})
    stages.write_stage(make([("b", 7, 8)]), folder, "bursts", {"max_gap": 3})
    back = stages.read_stage(spark, folder, "bursts")
    assert sorted((r.rec_id, r.start, r.stop) for r in back.collect()) == [("a", 1, 2), ("b", 7, 8)]
    one = stages.read_stage(spark, folder, "bursts", ["a"])
    assert [tuple(r) for r in one.select("rec_id", "start").collect()] == [("a", 1)] and "IsNotNull(rec_id)" in one._jdf.queryExecution().toString()
    stages.note(spark, folder, "a", "quality", "weak")
    stages.note(spark, folder, "a", "quality", "nice")
    got = {(r.subject, r.name): r.value for r in stages.notes(spark, folder).collect()}
    assert got == {("bursts", "parameters"): '{"max_gap": 3}', ("a", "quality"): "nice"}


def test_signals_from_memory(spark):
    x = {"a": np.arange(1000.0), "b": np.zeros(0), "c": np.ones(256)}
    got = G.to_samples(stages.from_arrays(spark, x, 500.0, 256)).orderBy("rec_id", "i").collect()
    assert [(r.rec_id, r.i, r.v) for r in got] == [("a", i, float(i)) for i in range(1000)] + [("c", i, 1.0) for i in range(256)]


def test_rows_of_one_span_are_written_by_one_task(spark, tmp_path):
    """Tasks sort and write what was dealt to them by span, so a span has one file however many tasks made its rows."""
    rows = spark.range(0, 800, 1, 8).selectExpr("CAST(id % 7 AS string) AS rec_id", "id AS t")
    stages.write_stage(rows, str(tmp_path), "events", span=1_000_000)
    assert len(list((tmp_path / "events" / "rows").rglob("*.parquet"))) == 1
    assert stages.read_stage(spark, str(tmp_path), "events").count() == 800


def test_documents_are_written_by_all_tasks(spark, sf_dir, monkeypatch):
    """Nothing before the writing of documents is drawn into a fixed number of tasks."""
    from pulsegrid import queries as Q

    def no(self, n):
        raise AssertionError(f"coalesce({n})")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", no)
    assert Q.diagnostics_documents(spark, sf_dir).count() > 0

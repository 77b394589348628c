"""Protocols of stages, stage tables and cutouts, documents, functions over pieces."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import pieces as P
from pulsegrid.plans.protocol import Protocol, Settings, Stage
from pulsegrid.sources import documents, stages


def events(spark, path, extra=()):
    rows = [("007", t) for t in (1, 2, 30, 31)] + [("08", t) for t in (5, 50)] + list(extra)
    spark.createDataFrame(rows, "rec_id string, t long").coalesce(1).write.mode("overwrite").parquet(path)
    return {"events": path}


def protocol(folder, ran):
    def late(tables, p):
        ran.append(("late", p["after"]))
        return tables["events"].where(F.col("t") > p["after"])

    def count(tables, p):
        ran.append(("count", p["times"]))
        if p["times"] == 13:
            raise RuntimeError("killed")
        return tables["late"].groupBy("rec_id").agg((F.count("*") * p["times"]).alias("n"))

    return Protocol([Stage("count", count, ("late",), {"times": 1}), Stage("late", late, ("events",), {"after": 1})], folder)


def test_protocol_resumes_and_repeats_what_changed(spark, tmp_path):
    source, ran = events(spark, str(tmp_path / "events")), []
    own = protocol(str(tmp_path / "out"), ran)
    n = lambda made: {r.rec_id: r.n for r in made["count"].collect()}
    with pytest.raises(RuntimeError):
        own.run(spark, source, Settings({"count": {"times": 13}}))
    assert n(own.run(spark, source)) == {"007": 3, "08": 2}
    assert ran == [("late", 1), ("count", 13), ("count", 1)]  # what the failed run had made whole is taken
    assert n(own.run(spark, source)) == {"007": 3, "08": 2} and own.made == [] and len(ran) == 3
    assert n(own.run(spark, source, Settings({"count": {"times": 2}}))) == {"007": 6, "08": 4} and ran[3:] == [("count", 2)]
    ran.clear()
    single = Settings({}, {"08": {"late": {"after": 20}}})
    assert n(own.run(spark, source, single)) == {"007": 3, "08": 1} and len(own.made) == 4
    ran.clear()
    assert n(own.run(spark, source, Settings({}, {"08": {"late": {"after": 20}, "count": {"times": 5}}}))) == {"007": 3, "08": 5} and ran == [("count", 5)]
    ran.clear()
    events(spark, source["events"], [("09", 8)])
    assert n(own.run(spark, source)) == {"007": 3, "08": 2, "09": 1} and ran == [("late", 1), ("count", 1)]
    (tmp_path / "out" / own.made[1] / "_SUCCESS").unlink()  # as if the stage had been cut off
    ran.clear()
    assert n(own.run(spark, source)) == {"007": 3, "08": 2, "09": 1} and ran == [("count", 1)]


def test_settings(spark, tmp_path):
    own = protocol(str(tmp_path), [])
    file = tmp_path / "settings.yml"
    file.write_text(Settings.template(list(own.stages.values())).replace("after: 1", "after: 4").replace("recordings: {}", "recordings:\n  '007':\n    count: {times: 3}\n"))
    read = Settings.read(spark, str(file))
    assert read.of(own.stages["late"]) == {"after": 4} and read.of(own.stages["count"], "007") == {"times": 3} and read.of(own.stages["count"], "08") == {"times": 1}
    for wrong in (Settings({"late": {"befor": 1}}), Settings({}, {"a": {"late": {"befor": 1}}}), Settings({"lat": {}}), Settings({}, {"a": {"lat": {}}})):
        with pytest.raises(ValueError, match="unknown"):
            own.run(spark, events(spark, str(tmp_path / "events")), wrong)
    with pytest.raises(ValueError, match="circle"):
        Protocol([Stage("a", None, ("b",)), Stage("b", None, ("a",))], "x").order(set())
    file.write_text("sharde: {}")
    with pytest.raises(ValueError, match="unknown sections"):
        Settings.read(spark, str(file))


def test_stages_keep_ids_and_cut(spark, tmp_path):
    folder, hour = str(tmp_path), stages.SPAN
    bursts = [("007", 0, 10), ("007", 5 * hour, 5 * hour + 10), ("08", 2 * hour - 5, 4 * hour), ("08", 9 * hour, 9 * hour + 1)]
    stages.write_stage(spark.createDataFrame(bursts, "rec_id string, start long, stop long"), folder, "bursts")
    stages.write_stage(spark.createDataFrame([("007", h * hour) for h in range(10)], "rec_id string, t long"), folder, "events")
    assert {r.rec_id for r in stages.read_stage(spark, folder, "bursts").collect()} == {"007", "08"}
    cut = stages.cutout(spark, folder, "bursts", 2 * hour, 5 * hour)
    assert sorted(map(tuple, cut.collect())) == [("08", 2 * hour - 5, 4 * hour)]  # a burst that only touches the border is out
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_span" in plan.split("PartitionFilters")[1].split("]")[0]
    whole = spark.read.parquet(f"{folder}/bursts/rows").where("_span BETWEEN 1 AND 5").select(F.input_file_name().alias("f")).distinct().count()
    assert whole == 2 and len(list((tmp_path / "bursts" / "rows").rglob("*.parquet"))) == 4  # of four files two lie in those spans
    every = stages.cutouts(spark, folder, 2 * hour, 5 * hour, ["007"])
    assert set(every) == {"bursts", "events"} and every["events"].count() == 4 and every["bursts"].count() == 0
    stages.write_stage(spark.createDataFrame([("007", 1, 2)], "rec_id string, start long, stop long"), folder, "bursts", recordings=spark.createDataFrame([("08",)], "rec_id string"))
    assert [tuple(r) for r in stages.read_stage(spark, folder, "bursts").collect()] == [("007", 1, 2)]  # 08 was named and has no row now
    stages.write_stage(spark.createDataFrame([(7, 3)], "rec_id long, n_events long"), str(tmp_path / "other"), "diagnostics")
    assert stages.read_stage(spark, str(tmp_path / "other"), "diagnostics").dtypes == [("rec_id", "bigint"), ("n_events", "bigint")]
    with pytest.raises(ValueError, match="quality is one of"):
        stages.note(spark, folder, "007", "quality", "great")


def test_a_killed_write_is_not_seen(spark, tmp_path, monkeypatch):
    folder, table = str(tmp_path), lambda n: spark.createDataFrame([("a", n, n + 1)], "rec_id string, start long, stop long")
    stages.write_stage(table(1), folder, "bursts")
    monkeypatch.setattr(stages, "REC", "gone")  # fails after nothing or the rows have been written
    with pytest.raises(Exception, match="gone"):
        stages.write_stage(table(5), folder, "bursts")
    monkeypatch.undo()
    table(9).withColumn("_span", F.lit(0).cast("long")).withColumn("_run", F.lit(2**60)).write.mode("append").partitionBy("_run", "_span").parquet(f"{folder}/bursts/rows")
    assert [r.start for r in stages.read_stage(spark, folder, "bursts").collect()] == [1]


def test_documents(spark, tmp_path):
    documents.register(spark)
    rows = spark.createDataFrame([("r/1", 3, None, [1, 2], {"k": 'é "q"'}), ("r 2", 4, float("inf"), [], {})], "rec_id string, n long, rate double, parts array<long>, notes map<string,string>")
    own = rows.select("rec_id", F.struct("n", "rate").alias("counts"), "parts", "notes").repartition(2)
    for form in ("json", "yaml"):
        folder = tmp_path / form
        folder.mkdir()
        own.write.format("documents").option("form", form).mode("append").save(str(folder))
        assert sorted(p.name for p in folder.iterdir()) == [f"r 2.{form}", f"r%2F1.{form}"]
    assert json.loads((tmp_path / "json" / "r%2F1.json").read_text()) == {"rec_id": "r/1", "counts": {"n": 3}, "parts": [1, 2], "notes": {"k": 'é "q"'}}
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load((tmp_path / "yaml" / "r%2F1.yaml").read_text()) == {"rec_id": "r/1", "counts": {"n": 3}, "parts": [1, 2], "notes": {"k": 'é "q"'}}
    assert yaml.safe_load((tmp_path / "yaml" / "r 2.yaml").read_text()) == {"rec_id": "r 2", "counts": {"n": 4, "rate": float("inf")}, "parts": [], "notes": {}}
    own.where("rec_id = 'r 2'").write.format("documents").mode("overwrite").save(str(tmp_path / "json"))
    assert [p.name for p in (tmp_path / "json").iterdir()] == ["r 2.json"]


def test_a_failed_job_leaves_no_document(spark, tmp_path):
    documents.register(spark)
    bad = spark.range(0, 40, 1, 4).select(F.col("id").alias("rec_id"), F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("documents").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith("_")] == []  # a task that was still writing may leave its own folder
    with pytest.raises(Exception, match="several rows of one rec_id"):
        spark.range(4).selectExpr("id div 2 AS rec_id", "id AS n").write.format("documents").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith("_")] == []
    with pytest.raises(Exception, match="no column"):
        spark.range(4).write.format("documents").option("key", "x").mode("append").save(str(tmp_path))


def test_pieces_larger_than_a_batch(spark):
    """A function sees all rows of a piece, in order, whatever the batches; it may stop early."""
    rows = [("a", t, "x") for t in range(0, 1000, 5)] + [("b", t, "y") for t in (3, 1, 2)] + [("c", None, "z"), (None, 4, "z")]
    table = spark.createDataFrame(rows, "rec_id string, t long, n string").repartition(3)
    masks = spark.createDataFrame([("a", 400, 500)], "rec_id string, start long, stop long")
    bounds = spark.createDataFrame([("a", 0, 995), ("b", 0, 10), ("c", 0, 10)], "rec_id string, lo long, hi long")

    def steps(batches):
        ts = [t for b in batches for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_pydict({"k": pa.array([len(ts)], pa.int64()), "sorted": pa.array([ts == sorted(ts)])})
        yield pa.RecordBatch.from_pydict({"k": pa.array([-ts[-1]], pa.int64()), "sorted": pa.array([True])})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    got = sorted(map(tuple, P.over_pieces(table, masks, bounds, steps, "k long, sorted boolean").collect()))
    first = sorted(map(tuple, P.over_pieces(table, masks, bounds, lambda bs: iter([next(bs).select(["n"]).slice(0, 1)]), "n string").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("a", 0, 400, -400, True), ("a", 0, 400, 81, True), ("a", 500, 995, -995, True), ("a", 500, 995, 100, True), ("b", 0, 10, -3, True), ("b", 0, 10, 3, True)]
    assert first == [("a", 0, 400, "x"), ("a", 500, 995, "x"), ("b", 0, 10, "y")]

"""Chunked signals give what whole ones give; streams give what tables give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import signal as S
from pulsegrid.operators.events import gap_islands
from pulsegrid.streaming.events import stream_islands, stream_rates

RNG = np.random.default_rng(2)
X = {"a": RNG.normal(size=1000), "b": np.sin(np.arange(700) / 9) * 20 + 3}


def chunks(spark, length=256):
    rows = [(r, i, float(v)) for r, x in X.items() for i, v in enumerate(x)]
    return S.to_chunks(spark.createDataFrame(rows, "rec_id string, i long, v double").repartition(5), length, 500.0)


def whole(df, value="v"):
    out = {}
    for r in df.orderBy("rec_id", "i").collect():
        out.setdefault(r["rec_id"], []).append(r[value])
    return out


def test_chunks_round_trip(spark):
    assert whole(S.to_samples(chunks(spark))) == {r: x.tolist() for r, x in X.items()}


def test_spectrogram_has_no_seams(spark):
    got = S.spectrogram(chunks(spark)).cache()
    for rec, x in X.items():
        want = S.spectral_power(x, 128)[:, 2:11]
        rows = got.where(F.col("rec_id") == rec).orderBy("i", "bin").collect()
        assert len(rows) == (len(x) - 127) * 9 and {r.bin for r in rows} == set(range(2, 11))
        assert np.allclose([r.power for r in rows], want.ravel())
        lo, hi = np.percentile(want, [5, 95], axis=0)
        mean = np.clip((want - lo) / (hi - lo), 0, 1).mean(axis=1)
        z = whole(S.band_power(chunks(spark)))[rec]
        assert np.allclose(z, (mean - mean.mean()) / mean.std())
        z, at = whole(S.band_power(chunks(spark), scope="chunk"))[rec], 0
        while at < len(want):
            own = want[at : at + 256]
            lo, hi = np.percentile(own, [5, 95], axis=0)
            mean = np.clip((own - lo) / (hi - lo), 0, 1).mean(axis=1)
            assert np.allclose(z[at : at + 256], (mean - mean.mean()) / mean.std())
            at += 256


def test_smoothing(spark):
    got = whole(S.to_samples(S.smooth(chunks(spark), 21, 2)))
    kernel = S.smoothing_kernel(21, 2)
    for rec, x in X.items():
        padded = np.concatenate([2 * x[0] - x[1:11][::-1], x, 2 * x[-1] - x[-11:-1][::-1]])
        assert np.allclose(got[rec], np.convolve(padded, kernel[::-1], "valid"))
    line = np.arange(50) * 2.0 + 1
    assert np.allclose(np.convolve(line, kernel[::-1], "valid"), line[10:-10])


def test_center(spark):
    got = whole(S.to_samples(S.center(chunks(spark))))
    assert np.allclose(got["a"], X["a"] - X["a"].mean()) and np.allclose(got["b"], (X["b"] - X["b"].mean()) / 1000)


def test_change_points(spark):
    x = RNG.normal(size=300) * 0.1
    x[100:200] += 6
    assert [a.at for a in S.cusum_alarms(x, 4, 1.5)] == [100, 200]
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "rec_id string, i long, v double")
    assert [(r.rec_id, r.i) for r in S.change_points(frame, ["rec_id"], "i", "v", 1.5, 0.5).orderBy("i").collect()] == [("a", 100), ("a", 200)]


@pytest.mark.parametrize("kind", ["islands", "rates"])
def test_streams(spark, sf_dir, tmp_path, kind):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"))
    end = table.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("rec_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    for i, part in enumerate((table, end, end.withColumn("ts", F.col("ts") + F.expr("interval 1 day")))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema("rec_id long, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("p")
    made = stream_islands(stream, 18_000_000_000, "1 hour") if kind == "islands" else stream_rates(stream, "1 day", "1 hour")
    made.writeStream.format("memory").queryName(f"made_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.table(f"made_{kind}").where("rec_id >= 0")
    if kind == "islands":
        want = gap_islands(table.select("rec_id", F.unix_micros("ts").alias("t")), 18_000_000_000)
        assert sorted(map(tuple, got.select("rec_id", F.unix_micros("start"), F.unix_micros("stop"), "n").collect())) == sorted(map(tuple, want.collect()))
    else:
        assert sorted(r.n for r in got.collect()) == sorted(r["count"] for r in table.groupBy("rec_id", F.date_trunc("day", "ts")).count().collect())

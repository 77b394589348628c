"""EDF files written by hand are read back, whole and over many partitions."""

import numpy as np
import pytest

from pulsegrid.sources import edf


def write(path, signals, rate, seconds=1.0, known=True):
    """signals: label -> integer samples; one record a second."""
    labels, data = list(signals), np.array(list(signals.values()), "<i2")
    records = data.shape[1] // rate
    n = len(labels)
    head = f"{'0':<8}{'x':<80}{'x':<80}{'01.01.24':<8}{'00.00.00':<8}{256 * (n + 1):<8}{'':<44}{records if known else -1:<8}{seconds:<8}{n:<4}"
    for values, width in ((labels, 16), ([""] * n, 80), (["mV"] * n, 8), (["-100"] * n, 8), (["100"] * n, 8), (["-1000"] * n, 8), (["1000"] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        head += "".join(f"{x!s:<{width}}" for x in values)
    path.write_bytes(head.encode("latin-1") + data.reshape(n, records, rate).transpose(1, 0, 2).tobytes())


def read(spark, path, **options):
    edf.register(spark)
    rows = spark.read.format("edf").options(**options).load(str(path)).orderBy("rec_id", "chunk_id").collect()
    return {k: np.concatenate([r.v for r in rows if r.rec_id == k]) for k in {r.rec_id for r in rows}}, rows


def test_read(spark, tmp_path):
    x = np.random.default_rng(1).integers(-1000, 1000, (2, 50 * 7))
    write(tmp_path / "one.edf", {"EDF Annotations": x[0] * 0, "left": x[0], "right": x[1]}, 50)
    write(tmp_path / "two.edf", {"left": x[1]}, 50, known=False)
    (tmp_path / "note.txt").write_text("no recording")
    got, rows = read(spark, tmp_path, recordsPerChunk=3)
    assert got["one"] == pytest.approx(x[0] / 10) and got["two"] == pytest.approx(x[1] / 10)
    assert [(r.chunk_id, r.i0, r.sr, len(r.v)) for r in rows if r.rec_id == "one"] == [(0, 0, 50.0, 150), (1, 150, 50.0, 150), (2, 300, 50.0, 50)]
    got, rows = read(spark, tmp_path / "one.edf", channel="right")
    assert got["one"] == pytest.approx(x[1] / 10) and rows[0].chan == "right"


def test_unknown_channel(spark, tmp_path):
    write(tmp_path / "one.edf", {"left": np.zeros(50, int)}, 50)
    with pytest.raises(Exception, match="unknown channel"):
        read(spark, tmp_path, channel="none")

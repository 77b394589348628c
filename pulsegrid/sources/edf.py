"""European Data Format as a Spark data source: `spark.read.format("edf").option("channel", name).load(path)`.

A file is a header of fixed-width text and data records of equal length, each with the 16-bit samples of all signals one after the
other. Files are cut into ranges of records, which tasks read on their own, so a long recording is spread over many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Widths of the fields that each signal has in the header, in their order.
SIGNAL_FIELDS = {"label": 16, "transducer": 80, "unit": 8, "low": 8, "high": 8, "digital_low": 8, "digital_high": 8, "filter": 80, "samples": 8, "reserved": 32}
SCHEMA = "rec_id string, chan string, chunk_id long, i0 long, sr double, v array<double>"


@dataclass(frozen=True)
class Header:
    size: int
    records: int
    seconds: float
    signals: tuple[dict, ...]

    @classmethod
    def parse(cls, f, length: int) -> Header:
        """From an open file; a number of records of -1 (still being written) follows from the file's length."""
        head = f.read(256).decode("latin-1")
        size, records, seconds, n = int(head[184:192]), int(head[236:244]), float(head[244:252]), int(head[252:256])
        fields = {}
        for name, width in SIGNAL_FIELDS.items():
            text = f.read(width * n).decode("latin-1")
            fields[name] = [text[k * width : (k + 1) * width].strip() for k in range(n)]
        signals = tuple({name: fields[name][k] for name in fields} for k in range(n))
        bytes_each = 2 * sum(int(s["samples"]) for s in signals)
        return cls(size, (length - size) // bytes_each if records < 0 else records, seconds, signals)

    def pick(self, channel: str | None) -> int:
        """Number of the signal of that label (none: the first that is no annotation)."""
        for k, s in enumerate(self.signals):
            if s["label"] == channel or (channel is None and s["label"] != "EDF Annotations"):
                return k
        raise ValueError(f"unknown channel {channel!r}; there are {[s['label'] for s in self.signals]}")


@dataclass
class Records(InputPartition):
    path: str
    signal: int
    first: int
    count: int
    header: Header


class EdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Records]:
        fs, root = _open(self.options["path"])
        found = [fs.get_file_info(root)]
        if found[0].type == pyarrow.fs.FileType.Directory:
            found = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if i.path.lower().endswith(".edf")]
        elif found[0].type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(root)
        each, parts = int(self.options.get("recordsperchunk", 60)), []
        for info in sorted(found, key=lambda i: i.path):
            with fs.open_input_file(info.path) as f:
                head = Header.parse(f, info.size)
            signal = head.pick(self.options.get("channel"))
            parts += [Records(info.path, signal, a, min(each, head.records - a), head) for a in range(0, head.records, each)]
        return parts

    def read(self, partition: Records) -> Iterator[tuple]:
        fs, _ = _open(self.options["path"])
        head, s = partition.header, partition.header.signals[partition.signal]
        sizes = [int(x["samples"]) for x in head.signals]
        width, own = sum(sizes), sizes[partition.signal]
        with fs.open_input_file(partition.path) as f:
            f.seek(head.size + 2 * width * partition.first)
            raw = np.frombuffer(f.read(2 * width * partition.count), "<i2").reshape(-1, width)
        before = sum(sizes[: partition.signal])
        low, high, dlow, dhigh = (float(s[k]) for k in ("low", "high", "digital_low", "digital_high"))
        v = (raw[:, before : before + own].astype(float) - dlow) * (high - low) / (dhigh - dlow) + low
        name = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        chunk = partition.first // int(self.options.get("recordsperchunk", 60))
        yield name, s["label"], chunk, partition.first * own, own / head.seconds, v.ravel().tolist()


class EdfSource(DataSource):
    """One row for `recordsPerChunk` records (60): (rec_id, chan, chunk_id, i0, sr, v) in physical units; rec_id is the file's name."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader({k.lower(): v for k, v in self.options.items()})


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def register(spark: SparkSession) -> None:
    """Makes format("edf") known to the session."""
    spark.dataSource.register(EdfSource)

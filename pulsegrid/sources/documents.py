"""A data source that writes one document a row: nested sections of a recording's metadata and diagnostics as JSON or YAML files.

`register(spark)`, then `df.write.format("documents").option("key", "rec_id").option("form", "yaml").mode("append").save(uri)`. Each row
becomes <key>.<form>; structs are sections, arrays and maps are written as they are, nulls are left out unless option `nulls` is true.

A task writes to a folder of its own. The driver moves the documents of all tasks to their places once all are written, and removes
the tasks' folders if the job fails, so no half document is ever found, and none of a job that failed. (A task that is still writing
then may leave its folder behind; its name begins with an underscore, so readers pass over it.)
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED = "_staged"


def _plain(value, nulls: bool):
    """Rows and what they hold as dicts, lists and scalars."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): _plain(v, nulls) for k, v in value.items() if nulls or v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v, nulls) for v in value]
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def _scalar(value) -> str:
    """A scalar that YAML and JSON read alike; numbers that JSON lacks as YAML spells them."""
    if isinstance(value, float) and value != value:
        return ".nan"
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return ".inf" if value > 0 else "-.inf"
    return json.dumps(value, ensure_ascii=False)


def yaml_text(value, depth: int = 0) -> str:
    """Nested dicts and lists as YAML, keys in their order; texts and keys are quoted."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k, ensure_ascii=False)}:" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {_scalar(v)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {_scalar(v)}\n") for v in value)
    return f"{pad}{_scalar(value)}\n"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.uri, self.key, self.form = options["path"].rstrip("/"), options.get("key", "rec_id"), options.get("form", "json")
        self.nulls, self.overwrite, self.job = str(options.get("nulls", "false")).lower() == "true", overwrite, uuid.uuid4().hex
        if self.key not in schema.names:
            raise ValueError(f"no column {self.key}")
        if self.form not in ("json", "yaml"):
            raise ValueError(f"unknown form: {self.form}")

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def write(self, rows: Iterator[Row]) -> Written:
        fs, top = self._open()
        folder, names = f"{top}/{STAGED}-{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for row in rows:
            own = _plain(row, self.nulls)
            name = f"{quote(str(own[self.key]), safe='-_. ')}.{self.form}"
            text = yaml_text(own) if self.form == "yaml" else json.dumps(own, ensure_ascii=False, indent=1) + "\n"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(text.encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = self._open()
        told = [m for m in messages if m is not None]
        every = [n for m in told for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError(f"several rows of one {self.key}")
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for old in fs.get_file_info(FileSelector(top)):
                if old.is_file and old.base_name.endswith((".json", ".yaml")):
                    fs.delete_file(old.path)
        for m in told:
            for name in m.names:
                fs.move(f"{m.folder}/{name}", f"{top}/{name}")
        self._clear(fs, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, fs, top: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{top}/{STAGED}-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{top}/{STAGED}-{self.job}")


class Documents(DataSource):
    """Options: path, key (rec_id), form (json or yaml), nulls (false)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)

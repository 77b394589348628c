"""Stages of an analysis as a graph, run over many recordings from one file of parameters, and resumed where nothing has changed.

A stage's result is named by a fingerprint of its name, version and parameters, of the recordings it is for and of its inputs'
fingerprints; those of source tables are the paths, sizes and times of their files. A result whose folder has been written whole is taken
as it is. So a run that was killed goes on where it stopped, and changed parameters of one recording repeat only what depends on them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import REC


@dataclass(frozen=True)
class Stage:
    """run(inputs by name, parameters) makes the stage's table, with a column rec_id, from tables of `inputs`: stages or sources.

    `defaults` names all parameters that there are. Another `version` makes earlier results out of date.
    """

    name: str
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    inputs: tuple[str, ...]
    defaults: dict = field(default_factory=dict)
    version: int = 1


@dataclass(frozen=True)
class Settings:
    """Parameters by stage: for all recordings, and for single ones (by rec_id)."""

    shared: dict[str, dict] = field(default_factory=dict)
    single: dict[object, dict[str, dict]] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        """From a YAML or JSON file with `shared` and `recordings` (both may be missing); it may lie wherever Spark reads."""
        import yaml

        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
        own = yaml.safe_load(text) or {}
        if unknown := set(own) - {"shared", "recordings"}:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        return cls(own.get("shared") or {}, own.get("recordings") or {})

    @staticmethod
    def template(stages: list[Stage]) -> str:
        """A file of all parameters with their defaults, to be filled in."""
        import yaml

        return yaml.safe_dump({"shared": {s.name: dict(s.defaults) for s in stages if s.defaults}, "recordings": {}}, sort_keys=False)

    def of(self, stage: Stage, recording=None) -> dict:
        """The stage's parameters, for a recording if it is given; unknown names are an error."""
        made = dict(stage.defaults)
        for own in (self.shared.get(stage.name) or {}, (self.single.get(recording) or {}).get(stage.name) or {}):
            if unknown := set(own) - set(stage.defaults):
                raise ValueError(f"unknown parameters of {stage.name}: {sorted(unknown)}")
            made |= own
        return made


def _print(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Protocol:
    def __init__(self, stages: list[Stage], folder: str):
        self.stages, self.folder = {s.name: s for s in stages}, folder.rstrip("/")
        if len(self.stages) < len(stages):
            raise ValueError("two stages of one name")
        self.made: list[str] = []  # stages that the last run had to work out, with their fingerprints

    def order(self, sources: set[str]) -> list[Stage]:
        """Stages, each after its inputs."""
        out, known, rest = [], set(sources), dict(self.stages)
        while rest:
            ready = [s for s in rest.values() if known >= set(s.inputs)]
            if not ready:
                raise ValueError(f"stages without their inputs, or in a circle: {sorted(rest)}")
            out += ready
            known |= {s.name for s in ready}
            rest = {n: s for n, s in rest.items() if n not in known}
        return out

    def _status(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _complete(self, spark: SparkSession, path: str) -> bool:
        fs, at = self._status(spark, f"{path}/_SUCCESS")
        return fs.exists(at)

    def _of_files(self, spark: SparkSession, path: str) -> str:
        """Fingerprint of the files of a source."""
        fs, at = self._status(spark, path)
        files, out = fs.listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return _print("files", sorted(out))

    def run(self, spark: SparkSession, sources: dict[str, str], settings: Settings | None = None, wanted: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of all stages (or of the wanted ones and what they need) from Parquet sources, given by path.

        Recordings with parameters of their own in any stage are worked out apart, those of equal parameters together; a
        stage's table is the union over these groups.
        """
        settings, self.made = settings or Settings(), []
        stages = self.order(set(sources))
        if wanted is not None:
            needed = set(wanted)
            for s in reversed(stages):
                needed |= set(s.inputs) if s.name in needed else set()
            stages = [s for s in stages if s.name in needed]
        if unknown := set(settings.shared) - set(self.stages):
            raise ValueError(f"unknown stages: {sorted(unknown)}")
        groups: dict[str, list] = {}
        for rec in sorted(settings.single, key=str):
            if unknown := set(settings.single[rec] or {}) - set(self.stages):
                raise ValueError(f"unknown stages of {rec}: {sorted(unknown)}")
            groups.setdefault(json.dumps([settings.of(s, rec) for s in stages], sort_keys=True), []).append(rec)
        groups.pop(json.dumps([settings.of(s) for s in stages], sort_keys=True), [])
        apart = [r for recs in groups.values() for r in recs]
        prints = {name: self._of_files(spark, path) for name, path in sources.items()}
        tables: dict[str, list[DataFrame]] = {s.name: [] for s in stages}
        for recs in [None, *groups.values()]:
            own, paths = dict(prints), {}
            first = None if recs is None else recs[0]
            for s in stages:
                parameters = settings.of(s, first)
                own[s.name] = _print(s.name, s.version, parameters, ["but", *apart] if recs is None else recs, [own[i] for i in s.inputs])
                paths[s.name] = f"{self.folder}/{s.name}/{own[s.name]}"
                if not self._complete(spark, paths[s.name]):
                    given = {i: self._cut(spark.read.parquet(sources[i]), recs, apart) if i in sources else spark.read.parquet(paths[i]) for i in s.inputs}
                    s.run(given, parameters).write.mode("overwrite").parquet(paths[s.name])
                    self.made.append(f"{s.name}/{own[s.name]}")
                tables[s.name].append(spark.read.parquet(paths[s.name]))
        out = {}
        for name, parts in tables.items():
            out[name] = parts[0]
            for p in parts[1:]:
                out[name] = out[name].unionByName(p)
        return out

    @staticmethod
    def _cut(table: DataFrame, recs: list | None, apart: list) -> DataFrame:
        """The rows of a group of recordings: those named, or all that no other group names."""
        if REC not in table.columns or (recs is None and not apart):
            return table
        return table.where(F.col(REC).isin(*recs)) if recs is not None else table.where(F.col(REC).isNull() | ~F.col(REC).isin(*apart))

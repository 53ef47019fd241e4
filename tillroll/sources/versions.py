"""Versioned layers: immutable table folders, and one manifest a published version.

    <layer>/_versions/<version>/<table>     the files of a version; never changed again
    <layer>/_manifests/<version>            one JSON row: number, version, table -> folder

A version is complete once its manifest's single file is there, and that file appears at
once (a rename within one folder, or one put on an object store).  Nothing is moved and
nothing that readers use is overwritten, so a load stopped at any point leaves the older
version in place for all of its tables together.  A reader pins the manifest that it
found first and reads that set until it asks again; a version that was superseded stays
readable until ``drop_versions``.

Manifests are written and listed by Spark's own reader and writer, so any store that
Spark reaches will do.  There is one writer a layer: two that publish at the same time
take the same number, and the later one to look finds it out and raises.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

VERSIONS, MANIFESTS = "_versions", "_manifests"


class VersionConflict(RuntimeError):
    """Another writer published the same number at the same time."""


@dataclass(frozen=True)
class Version:
    """What one manifest says: the folder of every table, and what its writer noted."""
    number: int
    name: str
    tables: dict[str, str]
    notes: dict[str, str] = field(default_factory=dict)


def new_name() -> str:
    return uuid.uuid4().hex


def folder_of(layer_dir: str, name: str, table: str) -> str:
    """Where the files of ``table`` in version ``name`` belong."""
    return f"{layer_dir.rstrip('/')}/{VERSIONS}/{name}/{table}"


def all_versions(spark: SparkSession, layer_dir: str) -> list[Version]:
    """Every published version, oldest first; empty for a layer without any."""
    try:
        lines = spark.read.text(f"{layer_dir.rstrip('/')}/{MANIFESTS}/*/part-*").collect()       # one row a version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [json.loads(r.value) for r in lines]
    root = layer_dir.rstrip("/")
    return sorted((Version(m["number"], m["version"], {t: p if "://" in p or p.startswith("/") else f"{root}/{p}"
                                                       for t, p in m["tables"].items()}, m.get("notes", {})) for m in found),
                  key=lambda v: (v.number, v.name))


def current_version(spark: SparkSession, layer_dir: str) -> Version | None:
    versions = all_versions(spark, layer_dir)
    return versions[-1] if versions else None


def commit_version(spark: SparkSession, layer_dir: str, name: str, tables: dict[str, str], keep: bool = True,
                   notes: dict[str, str] | None = None) -> Version:
    """Publishes ``tables`` (table -> complete folder) as version ``name``, all of them at once.

    ``keep``: tables of the current version that are not named go on as they are.  Folders
    below the layer are noted relative to it, so a layer can be moved.
    """
    root = layer_dir.rstrip("/")
    last = current_version(spark, layer_dir)
    every = (dict(last.tables) if last and keep else {}) | tables
    said = dict(last.notes if last and keep else {}) | (notes or {})
    row = {"number": last.number + 1 if last else 1, "version": name,
           "tables": {t: p.removeprefix(f"{root}/") for t, p in every.items()}, "notes": said}
    text = spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("errorifexists").text(f"{root}/{MANIFESTS}/{name}")
    rivals = [v for v in all_versions(spark, layer_dir) if v.number == row["number"]]
    if len(rivals) > 1:
        raise VersionConflict(f"{root}: {', '.join(v.name for v in rivals)} were published at the same time")
    return Version(row["number"], name, every, said)


def write_version(layer_dir: str, frames: dict[str, DataFrame], notes: dict[str, str] | None = None) -> Version:
    """Writes every frame as plain Parquet into a new version and publishes them together."""
    name = new_name()
    paths = {}
    for table, df in frames.items():
        paths[table] = folder_of(layer_dir, name, table)
        df.write.mode("errorifexists").parquet(paths[table])
    return commit_version(df.sparkSession, layer_dir, name, paths, notes=notes)


def drop_versions(spark: SparkSession, layer_dir: str, keep: int = 2) -> list[str]:
    """Deletes what only versions older than the ``keep`` newest use, and unpublished leftovers; names of the dropped.

    Manifests go before files, so no manifest names a folder that is gone.  Not for a
    layer whose writer is at work: its unpublished folders count as leftovers.
    """
    from tillroll.sources.landing import _fs

    if keep < 1:
        raise ValueError("at least the current version stays")
    root = layer_dir.rstrip("/")
    versions = all_versions(spark, layer_dir)
    old, new = versions[:-keep], versions[-keep:]
    for v in old:
        fs, p = _fs(spark, f"{root}/{MANIFESTS}/{v.name}")
        fs.delete(p, True)
    used = {p for v in new for p in v.tables.values()}
    fs, p = _fs(spark, f"{root}/{VERSIONS}")
    if not fs.exists(p):
        return [v.name for v in old]
    for version in fs.listStatus(p):
        left = 0
        for table in fs.listStatus(version.getPath()):
            mine = f"{root}/{VERSIONS}/{version.getPath().getName()}/{table.getPath().getName()}"
            if mine in used:
                left += 1
            else:
                fs.delete(table.getPath(), True)
        if not left:
            fs.delete(version.getPath(), True)
    return [v.name for v in old]

"""Files that driver and executors share: scratch tables, atomic markers, backups."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`. Where that is unset, in a temporary folder, which only a local master's
    executors share with the driver: on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loamlog-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loamlog/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps neither recompute it nor depend on
    the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes what write_table wrote, once all that reads it is written itself."""
    for df in tables:
        path = df.__dict__.get("_scratch_path")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Files:
    """Small files by Hadoop's file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        """Whole or not at all: written aside, then renamed. An existing file is an error."""
        if self.exists(name):
            raise FileExistsError(name)
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        if not self.fs.rename(self._path(aside), self._path(name)):
            self.fs.delete(self._path(aside), False)
            raise FileExistsError(name)

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)


class BackupError(Exception):
    """A backup that can't be read whole."""


def _checks(df: DataFrame) -> dict:
    """Rows, and a checksum that doesn't depend on their order."""
    row = F.crc32(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("crc"), F.max("sequence").alias("s"))
    first = got.first()
    return {"rows": first["n"], "checksum": first["crc"], "sequence": first["s"] or 0}


def write_backup(records: DataFrame, path: str, timestamp: int = 0) -> dict:
    """Writes records and, when they are complete, a manifest with their number and checksum."""
    files = Files(records.sparkSession, path)
    if files.exists("manifest.json"):
        raise FileExistsError(path)
    records.write.parquet(f"{path}/records")
    held = records.sparkSession.read.parquet(f"{path}/records")
    manifest = {"format": "loamlog-backup", "version": 1, "timestamp": timestamp, **_checks(held)}
    files.write("manifest.json", manifest)
    return manifest


def backup_info(spark: SparkSession, path: str) -> dict:
    files = Files(spark, path)
    if not files.exists("manifest.json"):
        raise BackupError("no manifest")
    manifest = files.read("manifest.json")
    if manifest.get("format") != "loamlog-backup" or manifest.get("version") != 1:
        raise BackupError("not a backup of a known version")
    return manifest


def read_backup(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The records of a backup; verify compares their number and checksum with the manifest first."""
    manifest = backup_info(spark, path)
    records = spark.read.parquet(f"{path}/records")
    if verify:
        got = _checks(records)
        if any(got[k] != manifest[k] for k in ("rows", "checksum")):
            raise BackupError(f"rows or checksum differ: {got}")
    return records


def valid_backup(spark: SparkSession, path: str) -> bool:
    try:
        read_backup(spark, path)
    except BackupError:
        return False
    return True

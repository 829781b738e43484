"""A table in parquet files that is changed by pointer: writers add files, then one small file is replaced.

Rows are dealt to a fixed number of buckets by mission.  A change reads and writes the buckets it touches; a manifest
names the files of every bucket, so the files of the others stay as they are.  Readers follow the pointer to a
manifest and never see a half-written change.  One writer at a time is assumed.  The driver holds one manifest, whose length is
bounded by the number of buckets, not by the number of rows or missions.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skysift.lineage import cut

BUCKETS = 256


class Store:
    """Small files in whatever store Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._folder = spark._jvm, folder
        hadoop = spark._jvm.org.apache.hadoop
        conf = spark._jsc.hadoopConfiguration()
        self._files = hadoop.fs.Path(folder).getFileSystem(conf)
        self._context = hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        flags = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        flags[0] = hadoop.fs.Options.Rename.OVERWRITE
        self._overwrite = flags

    def _path(self, name: str):
        return self._files.makeQualified(self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}"))

    def read(self, name: str) -> str | None:
        if not self._files.exists(self._path(name)):
            return None
        stream = self._files.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside and rename over, so that a reader finds the old or the new text."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._context.rename(self._path(beside), self._path(name), self._overwrite)

    def names(self, name: str) -> list[str]:
        if not self._files.exists(self._path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(name)))

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)


class VersionedTable:
    """Rows of ``schema`` (with ``mission_id``) in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.store = Store(spark, folder)
        found = self.manifest()
        self.buckets = found["buckets"] if found["version"] else buckets

    # ------------------------------------------------------------------ reading

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``buckets``, ``applied`` and ``files`` by bucket; version 0 is the empty table."""
        current = self.store.read("CURRENT") if version is None else str(version)
        text = self.store.read(f"manifests/{int(current):010d}.json") if current else None
        if current and text is None:
            raise ValueError(f"version {current} is not there")
        return json.loads(text) if text else {"version": 0, "buckets": 0, "applied": None, "files": {}}

    @property
    def applied(self) -> int | None:
        """Tag of the last change."""
        return self.manifest()["applied"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("mission_id"), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        files = self.manifest(version)["files"]
        wanted = files if buckets is None else [str(b) for b in buckets if str(b) in files]
        paths = [f"{self.folder}/{name}" for b in wanted for name in files[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the missions of ``rows``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def of_missions(self, missions: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the given missions; other buckets are not opened."""
        found = self.read(buckets=self.touched(missions) if buckets is None else buckets)
        return found.join(missions.select("mission_id").distinct(), "mission_id", "left_semi")

    # ------------------------------------------------------------------ changing

    def commit(self, rows: DataFrame, buckets: list[int], tag: int | None = None) -> int:
        """Make ``rows`` the whole content of ``buckets``; the other buckets keep their files.  Returns the new version.

        With no ``buckets`` the rows are added to what is there.
        """
        before = self.manifest()
        version = before["version"] + 1
        name = f"data/{version:010d}-{uuid.uuid4().hex}"
        # A large bucket is split into several files by adaptive execution, small ones share a task.
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", "mission_id").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        files = {b: names for b, names in before["files"].items() if int(b) not in set(buckets)}
        for path in self._new_files(name):
            files.setdefault(re.search(r"_bucket=(\d+)/", path)[1], []).append(path)
        after = {"version": version, "buckets": self.buckets, "applied": before["applied"] if tag is None else tag, "files": files}
        self.store.write(f"manifests/{version:010d}.json", json.dumps(after))
        self.store.write("CURRENT", str(version))
        return version

    def _new_files(self, name: str) -> list[str]:
        return [
            f"{name}/{part}/{file}"
            for part in self.store.names(name) if part.startswith("_bucket=")
            for file in self.store.names(f"{name}/{part}") if file.endswith(".parquet")
        ]

    def upsert(self, batch: DataFrame, key: str = "incident_id", version: str = "version", tag: int | None = None) -> int:
        """Keep the latest row of each (mission, key) over the table and ``batch``.

        Of equal versions a row of the batch wins over one of the table, and of several rows of the batch the one whose other
        columns are the largest.  A batch with the tag of the last change was applied already and changes nothing.
        """
        if tag is not None and self.applied is not None and tag <= self.applied:
            return self.manifest()["version"]
        batch = cut(batch.select(*self.schema.names))
        buckets = self.touched(batch)
        return self.commit(latest(self.read(buckets=buckets), batch, key, version), buckets, tag)

    def replace_missions(self, rows: DataFrame, missions: DataFrame, tag: int | None = None) -> int:
        """Make ``rows`` the whole content of ``missions``; other missions of their buckets are copied."""
        buckets = self.touched(missions)
        others = self.read(buckets=buckets).join(missions.select("mission_id").distinct(), "mission_id", "left_anti")
        return self.commit(others.unionByName(rows.select(*self.schema.names)), buckets, tag)

    def append(self, rows: DataFrame, tag: int | None = None, most: int = 64) -> int:
        """Add rows; a bucket of more than ``most`` files is then rewritten into few, so the manifest stays bounded."""
        if tag is not None and self.applied is not None and tag <= self.applied:
            return self.manifest()["version"]
        version = self.commit(rows, [], tag)
        crowded = [int(b) for b, files in self.manifest()["files"].items() if len(files) > most]
        return self.commit(self.read(buckets=crowded), crowded) if crowded else version

    def expire(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` versions do not name, and changes that were never finished."""
        now = self.manifest()["version"]
        kept = {f"{v:010d}.json": self.manifest(v) for v in range(max(1, now - keep + 1), now + 1)}
        named = {f.split("/")[1] for m in kept.values() for names in m["files"].values() for f in names}
        for name in self.store.names("data"):
            if name not in named:
                self.store.remove(f"data/{name}")
        for name in self.store.names("manifests"):
            if name not in kept:
                self.store.remove(f"manifests/{name}")


def latest(existing: DataFrame, batch: DataFrame, key: str = "incident_id", version: str = "version") -> DataFrame:
    """Latest row per (mission, key), by ``version``, then batch before table, then the largest other columns."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("mission_id", key, "_new")]
    best = F.max_by(F.struct(*others), F.struct(version, "_new", *[c for c in others if c != version]))
    return rows.groupBy("mission_id", key).agg(best.alias("_r")).select("mission_id", key, *[F.col("_r")[c].alias(c) for c in others])

"""A keyed table in buckets that increments are merged into, bucket by bucket, under numbered manifests.

A merge reads and rewrites the buckets that its increment's keys fall in and no others. It writes them to a folder of its own and then renames a
manifest to the next number, which names the folder of every bucket; that rename is the only step that readers can see. A merge that
breaks off before it leaves the table as it was, and of two merges at once the one whose number is taken fails. A reader keeps the
folders of the manifest it opened; ``vacuum`` deletes those that the last manifest does not name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """``keys``: the columns that name a row; a null key is a key. ``buckets`` is fixed when the first manifest is written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """The last manifest: version, buckets (number: folder), schema; version 0 where there is none."""
        fs, at = self._file("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": {}, "schema": None, "count": self.buckets}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, folder = self._file("manifests")
        fs.mkdirs(folder)
        _, draft = self._file(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._file(f"manifests/{manifest['version']:09d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another merge has written version {manifest['version']}")

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """All rows as of a manifest, the last by default; None before the first merge."""
        now = manifest or self.manifest()
        return self._rows(now, now["buckets"].values()) if now["version"] else None

    def _rows(self, manifest: dict, folders) -> DataFrame:
        schema, paths = manifest["schema"], [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, increment: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> int:
        """Merge an increment and return the new version.

        ``combine`` gets the rows of the touched buckets and of the increment, with ``ordinal`` (0 for stored rows, 1 for new ones),
        and returns a row a key without it. An empty increment writes nothing.
        """
        now = self.manifest()
        count = now["count"]
        touched = sorted(r[0] for r in increment.select(self._bucket(count)).distinct().collect())  # at most one a bucket
        if not touched:
            return now["version"]
        fresh = increment.withColumn("ordinal", F.lit(1))
        held = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
        both = self._rows(now, held).withColumn("ordinal", F.lit(0)).unionByName(fresh) if held else fresh
        done = combine(both)
        kept = done.select(*increment.columns).withColumn("_bucket", self._bucket(count))
        version = now["version"] + 1
        folder = f"data/{version:09d}-{uuid.uuid4().hex}"
        kept.repartition(min(count, len(touched)), "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        schema = now["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in increment.schema)
        written = {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._commit({"version": version, "buckets": now["buckets"] | written, "schema": schema, "count": count})
        return version

    def vacuum(self) -> int:
        """Delete the folders that no bucket of the last manifest is in, and tell how many; not while a merge runs."""
        fs, at = self._file("data")
        used = {f.split("/")[1] for f in self.manifest()["buckets"].values()}
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

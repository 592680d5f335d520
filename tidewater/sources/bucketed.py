"""A table with one row for each key, in hash buckets, whose updates rewrite only the buckets that they touch.

Each version has a manifest: for every bucket the folder of its rows. An update merges the touched buckets into new folders and writes a manifest with the next number, to a name
that nobody else has: readers take the highest and see the table before the update or after it. Who loses the race for a number merges again on top of the winner. Folders that no
kept manifest names are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert
from .files import _fs


class BucketedTable:
    """At ``path``, keyed by ``keys``; of rows of one key the one with the greatest ``order`` stays, those of a later update before those of an earlier one."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets

    def versions(self) -> list[int]:
        folder, fs = _fs(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``folders`` by bucket, ``schema`` and the number of the last ``batch``."""
        there = self.versions()
        if not there:
            return {"version": 0, "folders": {}, "schema": None, "batch": None}
        file, fs = _fs(self.spark, f"{self.path}/manifest-{version or there[-1]:09d}.json")
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rows(self, m: dict, of: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in m["folders"].items() if of is None or int(b) in of]
        return self.spark.read.schema(m["schema"]).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as its newest manifest has it, or an earlier one; None before the first update."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        rows = self._rows(m)
        return self.spark.createDataFrame([], m["schema"]) if rows is None else rows

    def _claim(self, m: dict) -> bool:
        tmp, fs = _fs(self.spark, f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        target, _ = _fs(self.spark, f"{self.path}/manifest-{m['version']:09d}.json")
        if not fs.exists(target) and fs.rename(tmp, target):
            return True
        fs.delete(tmp, False)
        return False

    def update(self, new: DataFrame, batch: int | None = None) -> list[int]:
        """Put rows in, and return the buckets that were rewritten. A ``batch`` that is not above the last one was put in already and changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = new.withColumn("_bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most as many as buckets
            while True:
                m = self.manifest()
                if batch is not None and m["batch"] is not None and batch <= m["batch"]:
                    return []
                rows = new.drop("_bucket")
                old = self._rows(m, touched)
                merged = upsert(rows.limit(0) if old is None else old, rows, self.keys, self.order).withColumn("_bucket", bucket)
                run = f"data-{uuid.uuid4().hex}"
                merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{run}")
                folders = m["folders"] | {str(b): f"{run}/_bucket={b}" for b in touched}
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
                if self._claim({"version": m["version"] + 1, "folders": folders, "schema": schema, "batch": m["batch"] if batch is None else batch}):
                    return touched
                folder, fs = _fs(self.spark, f"{self.path}/{run}")
                fs.delete(folder, True)
        finally:
            new.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the newest ``keep``, and folders that none of these names; readers of older versions must have ended, and no update may be under way."""
        there = self.versions()
        kept = {f.partition("/")[0] for v in there[-keep:] for f in self.manifest(v)["folders"].values()}
        folder, fs = _fs(self.spark, self.path)
        for v in there[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/manifest-{v:09d}.json")[0], False)
        for f in fs.listStatus(folder):
            if f.getPath().getName().startswith("data-") and f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)

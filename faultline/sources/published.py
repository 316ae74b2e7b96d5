"""Tables that are published as a whole: new files are staged, and one small manifest names those that count.

A table is cut into buckets by project. A change writes the buckets that it touches into a folder of its own and then a manifest
that names, for every table and bucket, the folder that holds it. Readers see the manifest of the greatest number, so they see all
of a change or nothing of it, and a job that dies leaves files that no manifest names. A change whose id a manifest names already
is done, so running it again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


class Published:
    """The published tables in a folder. ``tables`` gives each one's schema and key columns."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """The manifest that counts."""
        fs, home = self._fs(f"{self.path}/manifests")
        if not fs.exists(home):
            return {"number": 0, "changes": [], "tables": {}}
        names = sorted(s.getPath().getName() for s in fs.listStatus(home) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"number": 0, "changes": [], "tables": {}}
        row = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/{names[-1]}").first()
        return json.loads(row[0])

    def _switch(self, manifest: dict) -> None:
        """Writes the manifest under a name of its own and gives it its number by a rename, which one of two writers wins."""
        fs, at = self._fs(f"{self.path}/manifests/{uuid.uuid4().hex}.staged")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, to = self._fs(f"{self.path}/manifests/{manifest['number']:012d}.json")
        if fs.exists(to) or not fs.rename(at, to):
            fs.delete(at, False)
            raise RuntimeError(f"another change was published as number {manifest['number']}: run this one again")

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(self.tables[table][0])

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some buckets of it, as the manifest has it."""
        placed = (manifest or self.manifest())["tables"].get(table, {})
        paths = [p for b, p in placed.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(*paths)

    def apply(self, change: str, new: dict[str, DataFrame], merge: dict[str, object], remember: int = 1000) -> bool:
        """Merges new rows into the tables and publishes all of it at once; False if the change was published before.

        ``merge[table]`` makes of the old rows and the new rows of the touched buckets those that are to be there; by default a new
        row takes the place of that of its key. The ids of the last ``remember`` changes are kept.
        """
        from ..operators.relational import upsert

        manifest = self.manifest()
        if change in manifest["changes"]:
            return False
        tables = {t: dict(b) for t, b in manifest["tables"].items()}
        bucket = F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int")
        for table, rows in new.items():
            stage = f"{self.path}/{table}/{manifest['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            fresh = rows.select(*self.schema(table).names)
            touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # BUCKETS at most
            if not touched:
                continue
            old = self.read(table, touched, manifest)
            merged = merge[table](old, fresh) if table in merge else upsert(old, fresh, self.tables[table][1])
            merged.select(*self.schema(table).names).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(stage)
            tables.setdefault(table, {}).update({str(b): f"{stage}/bucket={b}" for b in touched})
        self._switch({"number": manifest["number"] + 1, "changes": [*manifest["changes"], change][-remember:], "tables": tables})
        return True

"""History tables on plain files: current rows are replaced, closed rows only appended.

A table is a folder with data folders and a small ``manifest`` table naming the data folders
of each version. A load writes new data folders first and appends its manifest rows last, in
one commit, so readers see either the old version or the new one. Closed rows of earlier
loads are referenced, never rewritten. One load at a time may publish to a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, role string, path string"


@dataclass(frozen=True)
class VersionedTable:
    root: str
    schema: T.StructType

    def _newest(self, spark: SparkSession) -> tuple[int, list[tuple[str, str]]]:
        """Newest version and its (role, path) list, one entry per load; (0, []) before the first."""
        try:
            manifest = spark.read.schema(_MANIFEST).json(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return 0, []
            raise
        version = manifest.agg(F.max("version")).first()[0]
        rows = manifest.filter(F.col("version") == version).collect()
        return version, [(r["role"], r["path"]) for r in rows if r["path"]]

    def version(self, spark: SparkSession) -> int:
        return self._newest(spark)[0]

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def current(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, [p for role, p in self._newest(spark)[1] if role == "current"])

    def closed(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, [p for role, p in self._newest(spark)[1] if role == "closed"])

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, [p for _, p in self._newest(spark)[1]])

    def publish(self, rows: DataFrame, closed: str = "_closed_now", reset: bool = False) -> int:
        """Write open and newly closed rows in one job, split by a boolean, then switch versions.

        With ``reset`` the new version forgets the closed rows of earlier loads.
        """
        spark = rows.sparkSession
        load = f"{self.root}/data/{uuid.uuid4().hex}"
        role = F.when(F.col(closed), "closed").otherwise("current")
        names = self.schema.fieldNames()
        rows.select(*names, role.alias("role")).write.partitionBy("role").parquet(load)
        # A role without rows has no folder; such a part is left out of the version.
        folders = spark.read.schema("role string").parquet(load)
        written = {r["role"] for r in folders.distinct().collect()}
        version, entries = self._newest(spark)
        kept = [] if reset else [(kind, path) for kind, path in entries if kind == "closed"]
        parts = [(kind, f"{load}/role={kind}") for kind in sorted(written)]
        listing = [(version + 1, kind, path) for kind, path in kept + parts]
        if not listing:
            listing = [(version + 1, "none", "")]
        manifest = spark.createDataFrame(listing, _MANIFEST)
        manifest.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return version + 1

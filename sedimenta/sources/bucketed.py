"""History tables in buckets of the business key: a load replaces only buckets with changed keys.

Layout below the root, all folders of Spark's partitioned writes::

    open/key_bucket=<b>                 rows a load may close
    closed/load_run=<r>/key_bucket=<b>  versions that run r closed
    keyless/load_run=<r>                rows of run r without a complete key: nothing ever matches them
    loads/load_run=<r>                  counts of run r, written last

Buckets come from a hash of the key, or for one whole-number key from its neighbourhood, so
that a batch of recent keys falls into few of them. Dynamic partition overwrite replaces the
folders that a load writes to and leaves the others as they are.

Each step can be repeated: versions are stored under the run that closed them before their
open rows go, bucket by bucket, and ``loads`` tells that a run is through. A run that died is
simply run again with the same context. One load at a time may write to a table; readers
should wait for it, as folders are replaced one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sources.workspace import remove

BUCKET, RUN = "key_bucket", "load_run"
_LOADS = f"{RUN} long, rows_read long, rows_inserted long, rows_updated long"


@dataclass(frozen=True)
class BucketedTable:
    """``width`` makes ``width`` consecutive numbers of a single key share a bucket, instead of a hash."""

    root: str
    schema: T.StructType
    keys: Sequence[str]
    buckets: int = 256
    width: int | None = None

    def bucket(self) -> Column:
        """The bucket of a row; null without a complete key."""
        typed = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        spot = F.floor(typed[0] / self.width) if self.width else F.xxhash64(*typed)
        return F.when(whole, F.pmod(spot.cast("long"), F.lit(self.buckets)).cast("int"))

    def _read(self, spark: SparkSession, part: str, extra: str) -> DataFrame:
        schema = T.StructType([*self.schema, *T._parse_datatype_string(extra)])
        try:
            return spark.read.schema(schema).parquet(f"{self.root}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def open(self, spark: SparkSession, buckets: Iterable[int] | None = None) -> DataFrame:
        """Open rows that a key can match, of all or only of some buckets."""
        rows = self._read(spark, "open", f"{BUCKET} int")
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(sorted(buckets)))
        return rows.select(*self.schema.names)

    def keyless(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "keyless", f"{RUN} long").select(*self.schema.names)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.open(spark).unionByName(self.keyless(spark))

    def closed(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "closed", f"{RUN} long, {BUCKET} int").select(*self.schema.names)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.current(spark).unionByName(self.closed(spark))

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows: at most as many numbers as the table has buckets."""
        found = rows.select(self.bucket().alias(BUCKET)).where(f"{BUCKET} IS NOT NULL").distinct()
        return sorted(r[0] for r in found.collect())

    def _write(self, rows: DataFrame, part: str, *by: str) -> None:
        # A rebalance keeps each folder's rows together, and splits or joins them by real size.
        spread = rows.hint("rebalance", *[F.col(c) for c in by])
        writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(f"{self.root}/{part}")

    def replace(self, rows: DataFrame, closed: str, run_id: int, reset: bool = False, keyless: bool = True) -> None:
        """Store the versions a load closed and put its open rows in place of their buckets.

        ``rows`` has all open rows of the buckets it touches, marked by the boolean ``closed``;
        it is read several times and must be stored. ``reset`` empties the table first;
        ``keyless`` tells whether there may be rows without a complete key.
        """
        spark = rows.sparkSession
        if reset:
            for part in ("open", "closed", "keyless"):
                remove(spark, f"{self.root}/{part}")
        rows = rows.select(*self.schema.names, closed, F.lit(run_id).cast("long").alias(RUN), self.bucket().alias(BUCKET))
        self._write(rows.where(closed).drop(closed), "closed", RUN, BUCKET)
        kept = rows.where(~F.col(closed)).drop(closed)
        if keyless:
            self._write(kept.where(f"{BUCKET} IS NULL").drop(BUCKET), "keyless", RUN)
        self._write(kept.where(f"{BUCKET} IS NOT NULL").drop(RUN), "open", BUCKET)

    def adopt(self, history: DataFrame, is_open: Column) -> None:
        """Fill an empty table from a history of another form; its closed rows count as those of run 0."""
        mark = F.coalesce(~is_open, F.lit(True))
        self.replace(history.withColumn("_closed", mark), "_closed", 0)

    def logged(self, spark: SparkSession, run_id: int) -> dict[str, int] | None:
        """Counts of a run that is through."""
        try:
            loads = spark.read.schema(_LOADS).parquet(f"{self.root}/loads")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = loads.where(F.col(RUN) == run_id).drop(RUN).first()
        return row.asDict() if row else None

    def log(self, spark: SparkSession, run_id: int, rows_read: int, rows_inserted: int, rows_updated: int) -> None:
        row = spark.createDataFrame([(run_id, rows_read, rows_inserted, rows_updated)], _LOADS)
        self._write(row, "loads", RUN)

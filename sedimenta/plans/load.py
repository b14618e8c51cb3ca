"""Whole loads: keys, SCD-2, publication and log rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.config import (
    JOB_RUN_SCHEMA,
    STEP_RUN_SCHEMA,
    Action,
    LoadSpec,
    RunContext,
    RunStatus,
)
from sedimenta.operators import scd2
from sedimenta.operators.surrogate import ensure_key_table, generate_surrogate_keys
from sedimenta.sources.bucketed import BucketedTable
from sedimenta.sources.versioned import VersionedTable
from sedimenta.sources.workspace import scope, stash


@dataclass(frozen=True)
class LoadCounts:
    rows_read: int = 0
    rows_inserted: int = 0
    rows_updated: int = 0
    rows_deleted: int = 0


def load_history(
    spark: SparkSession,
    staging: DataFrame,
    target: VersionedTable,
    spec: LoadSpec,
    ctx: RunContext,
    key_path: str | None = None,
    initial: bool = False,
) -> LoadCounts:
    """Generate missing keys, apply the batch, publish the new version, count what was written.

    The staging frame is evaluated once. A key table that doesn't exist yet is created. An
    initial load starts from an empty target; its key table is kept. Rows read are those of
    the staging frame, rows inserted and updated those that the publishing job wrote anew and
    closed. Intermediate folders go at the end.
    """
    with scope(spark):
        staging, rows_read = _staged(staging)
        keys = _keys(spark, staging, spec, ctx, key_path)
        current = spark.createDataFrame([], target.schema) if initial else target.current(spark)
        result = scd2.apply(current, staging, spec, ctx, keys)
        seen = Observation()
        target.publish(_observed(result.rows, seen), reset=initial)
        return LoadCounts(rows_read, seen.get["inserted"], seen.get["closed"])


def load_delta(
    spark: SparkSession,
    staging: DataFrame,
    target: BucketedTable,
    spec: LoadSpec,
    ctx: RunContext,
    key_path: str | None = None,
    initial: bool = False,
) -> LoadCounts:
    """As :func:`load_history` for a table in buckets: reads and replaces only what the batch concerns.

    Classification reads the buckets of the batch's keys, closing and publishing those of its
    new and changed keys. A run that is through, told by its ``run_id``, isn't repeated and
    returns its counts; one that died halfway is completed.
    """
    if ctx.run_id is None:
        raise ValueError("a load in buckets needs a run id, by which it can be repeated")
    if list(spec.business_key) != list(target.keys):
        raise ValueError(f"the table is kept by {target.keys}, the load by {spec.business_key}")
    if (done := target.logged(spark, ctx.run_id)) is not None:
        return LoadCounts(**done)
    with scope(spark):
        staging, rows_read = _staged(staging)
        keys = _keys(spark, staging, spec, ctx, key_path)
        none = spark.createDataFrame([], target.schema)
        current = none if initial else target.open(spark, target.buckets_of(staging))
        tagged = scd2.classify(staging, current, spec).filter(F.col(scd2.ACTION) != Action.UNCHANGED)
        tagged = stash(tagged, "classified")
        touched = none if initial else target.open(spark, target.buckets_of(tagged))
        seen = Observation()
        rows = stash(_observed(scd2.combine(tagged, touched, spec, ctx, keys).rows, seen, target.bucket().isNull()), "replaced")
        target.replace(rows, scd2.CLOSED_NOW, ctx.run_id, reset=initial, keyless=seen.get["keyless"] > 0)
        counts = LoadCounts(rows_read, seen.get["inserted"], seen.get["closed"])
        target.log(spark, ctx.run_id, counts.rows_read, counts.rows_inserted, counts.rows_updated)
        return counts


def _observed(rows: DataFrame, seen: Observation, keyless: Column | None = None) -> DataFrame:
    counts = {"inserted": F.col(scd2.INSERTED_NOW), "closed": F.col(scd2.CLOSED_NOW)}
    if keyless is not None:
        counts["keyless"] = keyless
    return rows.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()])


def _staged(staging: DataFrame) -> tuple[DataFrame, int]:
    """The staging frame, stored, and its number of rows."""
    seen = Observation()
    stored = stash(staging.observe(seen, F.count("*").alias("rows")), "staged")
    return stored, seen.get["rows"]


def _keys(
    spark: SparkSession, staging: DataFrame, spec: LoadSpec, ctx: RunContext, key_path: str | None
) -> DataFrame | None:
    """The key table with the keys of the batch; those it lacked are appended.

    A repeated run finds the keys of the run that died and appends what is still missing.
    """
    if spec.surrogate != "key_table":
        return None
    if key_path is None:
        raise ValueError("this load needs the path of its key table")
    known = _key_table(spark, key_path, ctx)
    fresh = generate_surrogate_keys(staging, known, spec.business_key, spec.domain, ctx, cut=spec.cut_keys)
    fresh.write.mode("append").parquet(key_path)
    return spark.read.schema(known.schema).parquet(key_path)


def _key_table(spark: SparkSession, path: str, ctx: RunContext) -> DataFrame:
    """The stored key table; a new one starts with the default member."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    ensure_key_table(spark, ctx).write.parquet(path)
    return spark.read.parquet(path)


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _append_log(spark: SparkSession, row: tuple, schema: StructType, path: str) -> None:
    """One row to a log, filed by the day its run or step started."""
    rows = spark.createDataFrame([row], schema).withColumn("day", F.to_date("start_time"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def _read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, log_root: str) -> DataFrame:
    """The last state of each run: of its newest attempt, ended if it has ended."""
    rows = _read_log(spark, f"{log_root}/job_run", JOB_RUN_SCHEMA)
    state = F.struct("start_time", F.col("end_time").isNotNull().alias("ended"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy("run_id").agg(F.max(state).alias("last")).select("last.row.*")


def read_steps(spark: SparkSession, log_root: str) -> DataFrame:
    """The last row of each step of each run."""
    rows = _read_log(spark, f"{log_root}/step_run", STEP_RUN_SCHEMA)
    state = F.struct("start_time", F.struct(*rows.columns).alias("row"))
    return rows.groupBy("run_id", "step_id").agg(F.max(state).alias("last")).select("last.row.*")


def load_with_log(
    spark: SparkSession,
    log_root: str,
    run_id: int,
    job_id: int,
    steps: list[tuple[int, Callable[[], LoadCounts]]],
    execution_mode: str = "DELTA",
    now: Callable[[], datetime] = _utc_now,
) -> str:
    """Run load steps and log the run and each step.

    A run says RUNNING before its first step starts, so a driver that dies leaves a row that
    :func:`sedimenta.operators.runlog.fail_stale` finds. A step is logged when it ends, which
    is its commit marker: the same run started again goes on behind its successful steps, and
    a run that has succeeded does nothing. The first failing step ends the run with status
    FAILED; the error is logged and raised. :func:`read_runs` and :func:`read_steps` give one
    row per run and step, however many attempts they took.
    """

    def log_run(*values) -> None:
        row = (run_id, job_id, started, *values, execution_mode, None)
        _append_log(spark, row, JOB_RUN_SCHEMA, f"{log_root}/job_run")

    def seconds(start: datetime, end: datetime) -> Decimal:
        return Decimal(str((end - start).total_seconds())).quantize(Decimal("0.000001"))

    mine = F.col("run_id") == run_id
    good = F.col("status") == RunStatus.SUCCESS
    if not read_runs(spark, log_root).where(mine & good).isEmpty():
        return RunStatus.SUCCESS
    done = {r[0] for r in read_steps(spark, log_root).where(mine & good).select("step_id").collect()}
    started, status, error = now(), RunStatus.SUCCESS, None
    log_run(None, None, RunStatus.RUNNING, None, None)
    for number, (step_id, step) in enumerate(steps, start=1):
        if step_id in done:
            continue
        begin = now()
        counts = LoadCounts()
        try:
            counts = step()
        except Exception as e:  # logged, then raised again below
            status, error = RunStatus.FAILED, e
        end = now()
        row = (
            (run_id << 20) + number, run_id, step_id, begin, end, seconds(begin, end), status,
            counts.rows_read, counts.rows_inserted, counts.rows_updated, counts.rows_deleted,
            str(error) if error else None, "N", None,
        )
        _append_log(spark, row, STEP_RUN_SCHEMA, f"{log_root}/step_run")
        if error:
            break
    ended = now()
    message, stack = (str(error), repr(error)) if error else (None, None)
    log_run(ended, seconds(started, ended), status, message, stack)
    if error:
        raise error
    return status

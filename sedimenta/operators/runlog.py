"""Analytics over jobs, steps and their run logs.

Input columns:

* ``jobs``: job_id, job_name, job_type, source_table_id, target_table_id, source_layer_id,
  target_layer_id, is_active
* ``steps``: step_id, job_id, step_name, step_order, step_category, is_active
* ``tables``: table_id, table_name, database_id; ``databases``: database_id, database_name, layer_id
* ``job_run`` and ``step_run``: as in :mod:`sedimenta.config`
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import RunStatus
from sedimenta.functions.text import timestamp
from sedimenta.operators.substring import matching_pairs

STALE_HOURS = 2
# Fixed value: the type of bulk-load jobs in the job table.
BULK_LOAD = "TPT_LOAD"
STALE_MESSAGE = "marked as failed: still running after the allowed time"


def latest_run(job_run: DataFrame, order: str = "start_time", columns: Sequence[str] = ("status",)) -> DataFrame:
    """Latest run of every job by ``order``, ties by run id. Missing times come last.

    An aggregate rather than a window: every task keeps one row per job before the shuffle,
    so a job with most of the runs is no heavier than the others.
    """
    fields = list(dict.fromkeys([order, "run_id", *columns]))
    best = job_run.groupBy("job_id").agg(F.max(F.struct(*fields)).alias("_best"))
    return best.select("job_id", *[F.col(f"_best.{c}").alias(c) for c in fields])


def active_step_counts(steps: DataFrame) -> DataFrame:
    return steps.filter(F.col("is_active") == "Y").groupBy("job_id").agg(F.count("*").alias("step_count"))


def _side(tables: DataFrame, databases: DataFrame, side: str) -> DataFrame:
    """Table names and layers for the source or target end of a job."""
    t = tables.select("table_id", "table_name", "database_id")
    d = databases.select("database_id", F.col("layer_id").alias("_layer"))
    return t.join(d, "database_id", "left").select(
        F.col("table_id").alias(f"{side}_table_id"),
        F.col("table_name").alias(f"{side}_table_name"),
        F.col("_layer").alias(f"_{side}_db_layer"),
    )


def job_details(
    jobs: DataFrame, steps: DataFrame, tables: DataFrame, databases: DataFrame, job_run: DataFrame
) -> DataFrame:
    """Jobs with table names, layers, active step count and last run.

    A layer is that of the table's database, else the one stored with the job.
    """
    last = latest_run(job_run).select(
        "job_id", F.col("status").alias("last_run_status"), F.col("start_time").alias("last_run_time")
    )
    joined = (
        jobs.join(_side(tables, databases, "source"), "source_table_id", "left")
        .join(_side(tables, databases, "target"), "target_table_id", "left")
        .join(active_step_counts(steps), "job_id", "left")
        .join(last, "job_id", "left")
    )
    return joined.select(
        "job_id", "job_name", "job_type", "source_table_id", "target_table_id", "is_active",
        "source_table_name", "target_table_name",
        F.coalesce("_source_db_layer", "source_layer_id").alias("source_layer_id"),
        F.coalesce("_target_db_layer", "target_layer_id").alias("target_layer_id"),
        F.coalesce("step_count", F.lit(0)).alias("step_count"),
        "last_run_status", "last_run_time",
    )


def job_overview(details: DataFrame, active_only: bool = False, layer_id: int | None = None) -> DataFrame:
    """Job list: optionally active jobs only, or jobs that touch a layer on either end."""
    if active_only:
        details = details.filter(F.col("is_active") == "Y")
    if layer_id is not None:
        details = details.filter((F.col("source_layer_id") == layer_id) | (F.col("target_layer_id") == layer_id))
    return details


def jobs_by_transition(details: DataFrame, source_layer: int, target_layer: int) -> DataFrame:
    """Jobs that lead from one layer to another."""
    return details.filter((F.col("source_layer_id") == source_layer) & (F.col("target_layer_id") == target_layer))


def tables_with_load_status(
    tables: DataFrame, databases: DataFrame, jobs: DataFrame, job_run: DataFrame, layer_id: int | None = None
) -> DataFrame:
    """Tables with the job that fills them, its last status, and the job that reads them.

    A table with several such jobs appears once per combination.
    """
    if layer_id is not None:
        databases = databases.filter(F.col("layer_id") == layer_id)
    d = databases.select("database_id", "database_name")
    last = latest_run(job_run).select(F.col("job_id").alias("job_id"), F.col("status").alias("job_status"))
    filled = (
        jobs.filter(F.col("target_table_id").isNotNull())
        .join(last, "job_id", "left")
        .select(F.col("target_table_id").alias("table_id"), "job_id", "job_name", "job_status")
    )
    downstream = tables.select(
        F.col("table_id").alias("target_table_id"), F.col("table_name").alias("downstream_target_table")
    )
    used = (
        jobs.filter(F.col("source_table_id").isNotNull())
        .join(downstream, "target_table_id", "left")
        .select(
            F.col("source_table_id").alias("table_id"),
            F.col("job_id").alias("downstream_job_id"),
            F.col("job_name").alias("downstream_job_name"),
            "downstream_target_table",
        )
    )
    return (
        tables.select("table_id", "table_name", "database_id")
        .join(d, "database_id")
        .join(filled, "table_id", "left")
        .join(used, "table_id", "left")
        .withColumns(
            {
                "has_job": F.col("job_id").isNotNull(),
                "is_used_as_source": F.col("downstream_job_id").isNotNull(),
            }
        )
    )


def run_details(
    job_run: DataFrame, step_run: DataFrame, jobs: DataFrame, steps: DataFrame, run_id: int | None = None
) -> DataFrame:
    """Step runs with their job run, one row per step; for one run or for all of them.

    A run without steps yet gives one row whose step columns are null.
    Rows stay flat: a nested list would gather all steps of a run in one place.
    """
    if run_id is not None:
        job_run = job_run.filter(F.col("run_id") == run_id)
        step_run = step_run.filter(F.col("run_id") == run_id)
    runs = job_run.join(jobs.select("job_id", "job_name"), "job_id").select(
        "run_id", "job_id", "job_name", F.col("status").alias("run_status"), F.col("start_time").alias("run_start"),
        F.col("end_time").alias("run_end"), F.col("duration_seconds").alias("run_seconds"),
        F.col("error_message").alias("run_error"),
    )
    named = steps.select("step_id", "step_name", "step_order", "step_category")
    return runs.join(step_run.join(named, "step_id"), "run_id", "left")


def run_totals(step_run: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows read, inserted and updated per run, leaving out statistics steps; skipped steps over all.

    A step run whose step is unknown counts.
    """
    kinds = steps.select("step_id", F.contains(F.upper("step_category"), F.lit("STATISTIC")).alias("_statistic"))
    relevant = ~F.coalesce(F.col("_statistic"), F.lit(False))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(relevant, F.col(column))), F.lit(0)).alias(f"total_{column[5:]}")

    return (
        step_run.join(kinds, "step_id", "left")
        .groupBy("run_id")
        .agg(
            total("rows_read"),
            total("rows_inserted"),
            total("rows_updated"),
            F.count_if(F.col("was_skipped") == "Y").alias("total_skipped"),
        )
    )


def run_history(
    job_run: DataFrame,
    job_id: int | None = None,
    status: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of runs, newest first; every task keeps only the rows the page may need."""
    if job_id is not None:
        job_run = job_run.filter(F.col("job_id") == job_id)
    if status is not None:
        job_run = job_run.filter(F.col("status") == status)
    return job_run.orderBy(F.desc("start_time"), F.desc("run_id")).offset(offset).limit(limit)


def run_history_after(
    job_run: DataFrame,
    start_time: str,
    run_id: int,
    job_id: int | None = None,
    status: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """The page behind a page whose last row has this start time and run id.

    Runs that can't be on the page are filtered at the scan, so a page costs the same however
    many came before it; no task holds more than ``limit`` rows.
    """
    at = timestamp(start_time)
    started = F.col("start_time")
    behind = (started <= at) & ((started < at) | (F.col("run_id") < run_id))
    return run_history(job_run.filter(behind), job_id, status, limit)


def recent_runs(job_run: DataFrame, count: int = 10) -> DataFrame:
    return run_history(job_run, limit=count)


def dashboard(jobs: DataFrame, job_run: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: jobs, active and running jobs, failures and success rate of the last hours."""
    recent = F.col("start_time") >= timestamp(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    status = F.col("status")
    runs = job_run.agg(
        F.count_distinct(F.when(status == RunStatus.RUNNING, F.col("job_id"))).alias("running_jobs"),
        F.count_if(recent & (status == RunStatus.FAILED)).alias("failed_runs"),
        F.count_if(recent & (status == RunStatus.SUCCESS)).alias("_success"),
        F.count_if(recent).alias("_recent"),
    )
    total = jobs.agg(F.count("*")).scalar()
    active = jobs.agg(F.count_if(F.col("is_active") == "Y")).scalar()
    return runs.select(
        total.alias("total_jobs"),
        active.alias("active_jobs"),
        "running_jobs",
        "failed_runs",
        F.when(F.col("_recent") > 0, F.col("_success") / F.col("_recent") * 100).alias("success_rate"),
    )


def job_performance(jobs: DataFrame, job_run: DataFrame, job_id: int | None = None) -> DataFrame:
    """Run counts, durations and success rate per job.

    ``total_runs`` counts joined rows, so it is 1 for a job that never ran; ``run_count``
    is the number of runs.
    """
    if job_id is not None:
        jobs = jobs.filter(F.col("job_id") == job_id)
    per_job = job_run.groupBy("job_id").agg(
        F.count("*").alias("run_count"),
        F.count_if(F.col("status") == RunStatus.SUCCESS).alias("success_count"),
        F.count_if(F.col("status") == RunStatus.FAILED).alias("failed_count"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        F.min("duration_seconds").alias("min_duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
    )
    joined = jobs.select("job_id", "job_name").join(per_job, "job_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("run_count", "success_count", "failed_count")}
    total = F.greatest(counts["run_count"], F.lit(1))
    return joined.withColumns(counts).select(
        "job_id", "job_name", total.alias("total_runs"), "run_count", "success_count", "failed_count",
        "avg_duration_seconds", "min_duration_seconds", "max_duration_seconds",
        (F.col("success_count") / total * 100).alias("success_rate"),
    )


def fail_stale(runs: DataFrame, as_of: str, hours: int = STALE_HOURS, message: str = STALE_MESSAGE) -> DataFrame:
    """A run log (of jobs or steps) in which runs that started too long ago count as failed."""
    now = timestamp(as_of)
    stale = (F.col("status") == RunStatus.RUNNING) & (
        F.col("start_time") < now - F.expr(f"INTERVAL {int(hours)} HOURS")
    )
    stale = F.coalesce(stale, F.lit(False))
    updates = {"status": F.lit(RunStatus.FAILED), "error_message": F.lit(message), "end_time": now}
    out = [F.when(stale, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
           for c in runs.columns]
    return runs.select(*out)


def import_status(jobs: DataFrame, job_run: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """For each table name, the bulk-load job whose name matches it and its last finished run.

    ``names`` are given as a list or as a frame with ``source_table``. ``%`` and ``_`` in a
    name act as wildcards. With several matching jobs the smallest job id counts. Names meet
    only jobs that share a rare letter group with them (:func:`matching_pairs`).
    """
    if not isinstance(names, DataFrame):
        names = jobs.sparkSession.createDataFrame([(n,) for n in names], "source_table string")
    wanted = names.select("source_table").distinct()
    texts = jobs.filter(F.col("job_type") == BULK_LOAD).select(F.col("job_id").alias("id"), F.col("job_name").alias("text"))
    pairs = matching_pairs(texts, wanted.select(F.col("source_table").alias("pattern")))
    first = pairs.groupBy(F.col("pattern").alias("source_table")).agg(F.min("id").alias("job_id"))
    last = latest_run(job_run, order="end_time").select(
        "job_id", F.col("status").alias("last_load_status"), F.col("end_time").alias("last_load_time")
    )
    return (
        wanted.join(first, "source_table", "left")
        .join(last, "job_id", "left")
        .select(
            "source_table", F.col("job_id").isNotNull().alias("has_job"), "job_id",
            "last_load_status", "last_load_time",
        )
    )

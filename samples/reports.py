"""Run-log and catalogue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from samples.support import AS_OF, FIXTURES, fixture, portable, query, ts_sql, ts_text
from sedimenta.functions.names import core_name
from sedimenta.functions.types import dictionary_type, type_name
from sedimenta.operators import catalog, runlog

# Name beginnings that are cut off, tried in this order.
CORE_PREFIXES = ["TAAA_", "TAAS_", "TAA_", "zas_", "ZAS_"]

FIXTURES["jobs"] = """
  SELECT c_custkey AS job_id, concat('LOAD_', c_mktsegment, '_', CAST(c_custkey AS STRING)) AS job_name,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'TPT_LOAD' ELSE 'SQL' END AS job_type,
         CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_custkey END AS source_table_id,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey > 20 THEN c_custkey + 1
              ELSE c_custkey + 25 END AS target_table_id,
         CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS source_layer_id,
         CASE WHEN c_nationkey < 12 THEN 2 ELSE 3 END AS target_layer_id,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'N' ELSE 'Y' END AS is_active
  FROM customer
"""
FIXTURES["steps"] = """
  SELECT o_orderkey AS step_id, o_custkey AS job_id, concat('STEP_', CAST(o_orderkey AS STRING)) AS step_name,
         CAST(LEFT(o_orderpriority, 1) AS INT) AS step_order,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'Collect_Statistics' WHEN o_orderpriority = '4-NOT SPECIFIED'
              THEN NULL ELSE 'SCD2' END AS step_category,
         CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS is_active
  FROM orders
"""
FIXTURES["job_run"] = """
  SELECT event_id AS run_id, user_id AS job_id, ts AS start_time,
         CASE WHEN event_type <> 'view' THEN ts END AS end_time,
         CAST(value AS DECIMAL(18,6)) AS duration_seconds,
         CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED'
              WHEN 'view' THEN 'RUNNING' ELSE 'SKIPPED' END AS status,
         CASE WHEN event_type = 'error' THEN props END AS error_message
  FROM events
"""
FIXTURES["step_run"] = """
  SELECT l_orderkey * 10 + l_linenumber AS step_run_id, l_partkey AS run_id, l_orderkey AS step_id,
         l_shipdate AS start_time, l_shipdate AS end_time,
         CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'N' THEN 'RUNNING' ELSE 'FAILED' END AS status,
         CAST(l_quantity AS BIGINT) AS rows_read, CAST(l_quantity AS BIGINT) + l_linenumber AS rows_inserted,
         CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS rows_updated,
         CAST(NULL AS STRING) AS error_message,
         CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS was_skipped
  FROM lineitem
"""
FIXTURES["layers"] = """
  SELECT r_regionkey + 1 AS layer_id, r_name AS layer_name, 10 - r_regionkey AS layer_sequence FROM region
"""
FIXTURES["dbs"] = """
  SELECT DISTINCT p_size AS database_id, concat('DB_', CAST(p_size AS STRING)) AS database_name,
         CASE WHEN p_size > 45 THEN NULL WHEN p_size > 30 THEN 3 WHEN p_size > 12 THEN 2 ELSE 1 END AS layer_id
  FROM part
"""
FIXTURES["tables"] = """
  SELECT p_partkey AS table_id, concat(upper(p_name), '_', CAST(p_partkey AS STRING)) AS table_name,
         p_size AS database_id, CASE WHEN p_size > 30 THEN 3 WHEN p_size > 12 THEN 2 ELSE 1 END AS layer_id,
         CASE WHEN p_type = 'PROMO' THEN NULL ELSE concat('holds ', p_brand) END AS comment_string,
         CASE WHEN p_type = 'SMALL' THEN 'V' ELSE 'T' END AS table_kind
  FROM part
"""


def _star(spark, sf_dir):
    return [fixture(spark, sf_dir, n) for n in ("jobs", "steps", "tables", "dbs", "job_run")]


FIXTURES["last_run"] = """
  SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY start_time DESC, run_id DESC) AS rn
                 FROM job_run r) t WHERE rn = 1
"""
FIXTURES["details"] = f"""
  SELECT j.job_id, j.job_name, j.job_type, j.source_table_id, j.target_table_id, j.is_active,
         st.table_name AS source_table_name, tt.table_name AS target_table_name,
         COALESCE(sd.layer_id, j.source_layer_id) AS source_layer_id,
         COALESCE(td.layer_id, j.target_layer_id) AS target_layer_id,
         (SELECT count(*) FROM steps s WHERE s.job_id = j.job_id AND s.is_active = 'Y') AS step_count,
         lr.status AS last_run_status, {ts_sql('lr.start_time', 'last_run_time')}
  FROM jobs j
  LEFT JOIN tables st ON j.source_table_id = st.table_id LEFT JOIN dbs sd ON st.database_id = sd.database_id
  LEFT JOIN tables tt ON j.target_table_id = tt.table_id LEFT JOIN dbs td ON tt.database_id = td.database_id
  LEFT JOIN last_run lr ON lr.job_id = j.job_id
"""


@query("SELECT * FROM details")
def job_details(spark, sf_dir):
    return portable(runlog.job_details(*_star(spark, sf_dir)))


@query("SELECT * FROM details WHERE is_active = 'Y' AND (source_layer_id = 2 OR target_layer_id = 2)")
def job_overview_of_layer(spark, sf_dir):
    details = runlog.job_details(*_star(spark, sf_dir))
    return portable(runlog.job_overview(details, active_only=True, layer_id=2))


@query("SELECT * FROM details WHERE source_layer_id = 1 AND target_layer_id = 2")
def jobs_between_layers(spark, sf_dir):
    return portable(runlog.jobs_by_transition(runlog.job_details(*_star(spark, sf_dir)), 1, 2))


@query("""
  SELECT t.table_id, t.table_name, t.database_id, d.database_name, jt.job_id, jt.job_name,
         lr.status AS job_status, js.job_id AS downstream_job_id, js.job_name AS downstream_job_name,
         td.table_name AS downstream_target_table, jt.job_id IS NOT NULL AS has_job,
         js.job_id IS NOT NULL AS is_used_as_source
  FROM tables t JOIN dbs d ON t.database_id = d.database_id
  LEFT JOIN jobs jt ON t.table_id = jt.target_table_id LEFT JOIN last_run lr ON jt.job_id = lr.job_id
  LEFT JOIN jobs js ON t.table_id = js.source_table_id LEFT JOIN tables td ON js.target_table_id = td.table_id
""")
def tables_with_load_status(spark, sf_dir):
    jobs, _, tables, dbs, job_run = _star(spark, sf_dir)
    return runlog.tables_with_load_status(tables, dbs, jobs, job_run)


@query(f"SELECT job_id, {ts_sql('start_time')}, run_id, status, duration_seconds FROM last_run")
def latest_run_per_job(spark, sf_dir):
    runs = fixture(spark, sf_dir, "job_run")
    return portable(runlog.latest_run(runs, columns=["status", "duration_seconds"]))


@query("""
  SELECT sr.step_id, r.run_id, sr.step_run_id, sr.status, sr.rows_read, sr.rows_inserted, sr.rows_updated,
         sr.was_skipped, s.step_name, s.step_order, s.step_category, r.job_id, j.job_name, r.status AS run_status,
         r.error_message AS run_error
  FROM job_run r JOIN jobs j ON r.job_id = j.job_id
  LEFT JOIN (step_run sr JOIN steps s ON sr.step_id = s.step_id) ON sr.run_id = r.run_id
""")
def run_step_details(spark, sf_dir):
    jobs, steps, _, _, job_run = _star(spark, sf_dir)
    flat = runlog.run_details(job_run, fixture(spark, sf_dir, "step_run"), jobs, steps)
    return flat.drop("start_time", "end_time", "error_message", "run_start", "run_end", "run_seconds")


@query("""
  SELECT sr.run_id,
         COALESCE(sum(rows_read) FILTER (COALESCE(upper(s.step_category), '') NOT LIKE '%STATISTIC%'), 0)::BIGINT AS total_read,
         COALESCE(sum(rows_inserted) FILTER (COALESCE(upper(s.step_category), '') NOT LIKE '%STATISTIC%'), 0)::BIGINT AS total_inserted,
         COALESCE(sum(rows_updated) FILTER (COALESCE(upper(s.step_category), '') NOT LIKE '%STATISTIC%'), 0)::BIGINT AS total_updated,
         count(*) FILTER (was_skipped = 'Y') AS total_skipped
  FROM step_run sr LEFT JOIN steps s ON sr.step_id = s.step_id GROUP BY sr.run_id
""")
def run_totals(spark, sf_dir):
    return runlog.run_totals(fixture(spark, sf_dir, "step_run"), fixture(spark, sf_dir, "steps"))


@query(f"""
  SELECT run_id, job_id, {ts_sql('start_time')}, status FROM job_run WHERE status = 'FAILED'
  ORDER BY job_run.start_time DESC, run_id DESC LIMIT 40 OFFSET 15
""")
def run_history_page(spark, sf_dir):
    page = runlog.run_history(fixture(spark, sf_dir, "job_run"), status="FAILED", limit=40, offset=15)
    return page.select("run_id", "job_id", ts_text("start_time"), "status")


@query(f"""
  SELECT run_id, job_id, {ts_sql('start_time')}, status FROM job_run WHERE status = 'FAILED'
  ORDER BY job_run.start_time DESC, run_id DESC LIMIT 40 OFFSET 40
""")
def run_history_next_page(spark, sf_dir):
    """The second page of forty, from the last row of the first."""
    runs = fixture(spark, sf_dir, "job_run")
    last = runlog.run_history(runs, status="FAILED", limit=40).orderBy("start_time", "run_id")
    row = last.select("run_id", ts_text("start_time")).first()
    page = runlog.run_history_after(runs, row["start_time"], row["run_id"], status="FAILED", limit=40)
    return page.select("run_id", "job_id", ts_text("start_time"), "status")


@query(f"SELECT run_id, {ts_sql('start_time')} FROM job_run ORDER BY job_run.start_time DESC, run_id DESC LIMIT 10")
def recent_runs(spark, sf_dir):
    return runlog.recent_runs(fixture(spark, sf_dir, "job_run")).select("run_id", ts_text("start_time"))


@query(f"""
  SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM jobs WHERE is_active = 'Y') AS active_jobs,
         (SELECT count(DISTINCT job_id) FROM job_run WHERE status = 'RUNNING') AS running_jobs,
         count(*) FILTER (status = 'FAILED') AS failed_runs,
         CAST(round(count(*) FILTER (status = 'SUCCESS') / count(*) * 100, 6) AS DECIMAL(18,4)) AS success_rate
  FROM job_run WHERE start_time >= CAST('{AS_OF}' AS TIMESTAMP) - INTERVAL 24 HOURS
""")
def dashboard(spark, sf_dir):
    board = runlog.dashboard(fixture(spark, sf_dir, "jobs"), fixture(spark, sf_dir, "job_run"), AS_OF)
    return board.withColumn("success_rate", F.round("success_rate", 6).cast("decimal(18,4)"))


@query("""
  SELECT j.job_id, j.job_name, count(*) AS total_runs, count(r.run_id) AS run_count,
         count(*) FILTER (r.status = 'SUCCESS') AS success_count, count(*) FILTER (r.status = 'FAILED') AS failed_count,
         CAST(round(avg(r.duration_seconds), 6) AS DECIMAL(18,3)) AS avg_duration_seconds,
         min(r.duration_seconds) AS min_duration_seconds, max(r.duration_seconds) AS max_duration_seconds,
         CAST(round(count(*) FILTER (r.status = 'SUCCESS') / count(*) * 100, 6) AS DECIMAL(18,4)) AS success_rate
  FROM jobs j LEFT JOIN job_run r ON j.job_id = r.job_id GROUP BY j.job_id, j.job_name
""")
def job_performance(spark, sf_dir):
    perf = runlog.job_performance(fixture(spark, sf_dir, "jobs"), fixture(spark, sf_dir, "job_run"))
    return perf.withColumns(
        {
            "avg_duration_seconds": F.round("avg_duration_seconds", 6).cast("decimal(18,3)"),
            "success_rate": F.round("success_rate", 6).cast("decimal(18,4)"),
        }
    )


STALE = f"status = 'RUNNING' AND start_time < CAST('{AS_OF}' AS TIMESTAMP) - INTERVAL 2 HOURS"


@query(f"""
  SELECT run_id, job_id, CASE WHEN {STALE} THEN 'FAILED' ELSE status END AS status,
         CASE WHEN {STALE} THEN '{runlog.STALE_MESSAGE}' ELSE error_message END AS error_message,
         CASE WHEN {STALE} THEN '{AS_OF}.000000' ELSE strftime(end_time, '%Y-%m-%d %H:%M:%S.%f') END AS end_time
  FROM job_run
""")
def stale_job_runs(spark, sf_dir):
    runs = runlog.fail_stale(fixture(spark, sf_dir, "job_run"), AS_OF)
    return portable(runs.select("run_id", "job_id", "status", "error_message", "end_time"))


@query(f"""
  SELECT CASE WHEN {STALE} THEN 'FAILED' ELSE status END AS status, count(*) AS step_runs
  FROM step_run GROUP BY 1
""")
def stale_step_runs(spark, sf_dir):
    runs = runlog.fail_stale(fixture(spark, sf_dir, "step_run"), AS_OF)
    return runs.groupBy("status").agg(F.count("*").alias("step_runs"))


WANTED = ["BUILDING_4", "BUILDING_1", "B_ILDING", "FURNITURE", "unknown"]


@query(f"""
  WITH wanted AS (SELECT unnest({WANTED}) AS source_table),
  hit AS (SELECT source_table, min(job_id) AS job_id FROM wanted JOIN jobs
          ON job_name LIKE '%' || source_table || '%' AND job_type = 'TPT_LOAD' GROUP BY source_table),
  ended AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY end_time DESC NULLS LAST, run_id DESC) AS rn
            FROM job_run)
  SELECT w.source_table, h.job_id IS NOT NULL AS has_job, h.job_id, e.status AS last_load_status,
         {ts_sql('e.end_time', 'last_load_time')}
  FROM wanted w LEFT JOIN hit h ON w.source_table = h.source_table LEFT JOIN ended e ON e.job_id = h.job_id AND rn = 1
""")
def table_import_status(spark, sf_dir):
    jobs, runs = fixture(spark, sf_dir, "jobs"), fixture(spark, sf_dir, "job_run")
    return portable(runlog.import_status(jobs, runs, WANTED))


# A name per customer, some with wildcards and some of two letters only.
FIXTURES["wanted_names"] = """
  SELECT concat(LEFT(c_mktsegment, 3), '%', '_', CAST(c_custkey AS STRING)) AS source_table FROM customer
  UNION SELECT concat('_', CAST(c_custkey AS STRING)) FROM customer
  UNION SELECT LEFT(c_mktsegment, 2) FROM customer
"""


@query(f"""
  WITH hit AS (SELECT source_table, min(job_id) AS job_id FROM wanted_names JOIN jobs
          ON job_name LIKE '%' || source_table || '%' AND job_type = 'TPT_LOAD' GROUP BY source_table),
  ended AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY end_time DESC NULLS LAST, run_id DESC) AS rn
            FROM job_run)
  SELECT w.source_table, h.job_id IS NOT NULL AS has_job, h.job_id, e.status AS last_load_status,
         {ts_sql('e.end_time', 'last_load_time')}
  FROM wanted_names w LEFT JOIN hit h ON w.source_table = h.source_table LEFT JOIN ended e ON e.job_id = h.job_id AND rn = 1
""")
def table_import_status_of_many(spark, sf_dir):
    jobs, runs, names = (fixture(spark, sf_dir, n) for n in ("jobs", "job_run", "wanted_names"))
    return portable(runlog.import_status(jobs, runs, names))


# --- catalogue -------------------------------------------------------------------------

FIXTURES["registered"] = """
  SELECT p_partkey AS column_id, CAST(p_size AS BIGINT) AS table_id,
         concat(p_name, '_', CAST(p_partkey AS STRING)) AS column_name, CAST(p_partkey AS INT) AS position,
         CASE WHEN p_brand = 'Brand#4' THEN concat(p_type, ' [DELETED]') ELSE p_type END AS column_type,
         CAST(floor(p_retailprice) AS INT) AS length, 'Y' AS nullable
  FROM part WHERE p_brand <> 'Brand#9'
"""
FIXTURES["actual"] = """
  SELECT CAST(p_size AS BIGINT) AS table_id,
         CASE WHEN p_brand = 'Brand#2' THEN upper(concat(p_name, '_', CAST(p_partkey AS STRING)))
              ELSE concat(p_name, '_', CAST(p_partkey AS STRING)) END AS column_name,
         CASE WHEN p_brand = 'Brand#8' THEN CAST(p_partkey AS INT) + 1 ELSE CAST(p_partkey AS INT) END AS position,
         CASE WHEN p_brand IN ('Brand#3', 'Brand#8') THEN concat('X', p_type) ELSE p_type END AS column_type,
         CASE WHEN p_brand = 'Brand#5' THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS length,
         CASE WHEN p_brand = 'Brand#6' THEN 'N' ELSE 'Y' END AS nullable
  FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#4')
"""
FIXTURES["paired"] = """
  SELECT COALESCE(r.table_id, a.table_id) AS table_id, r.column_id, r.column_name AS r_name, a.column_name AS a_name,
         r.position AS r_pos, a.position AS a_pos, r.column_type AS r_type, a.column_type AS a_type,
         r.length AS r_len, a.length AS a_len, r.nullable AS r_null, a.nullable AS a_null
  FROM registered r FULL OUTER JOIN actual a ON r.table_id = a.table_id AND upper(r.column_name) = upper(a.column_name)
"""


def drift_sql(*facets: str) -> str:
    short = {"column_type": "type", "length": "len", "nullable": "null", "position": "pos"}
    labels = {"column_type": "type", "length": "length", "nullable": "nullable", "position": "position"}
    differs = {f: f"r_{short[f]} IS DISTINCT FROM a_{short[f]}" for f in facets}
    messages = ", ".join(
        f"CASE WHEN {d} THEN '{labels[f]}: ' || COALESCE(CAST(r_{short[f]} AS VARCHAR), 'null') || ' -> ' || "
        f"COALESCE(CAST(a_{short[f]} AS VARCHAR), 'null') END"
        for f, d in differs.items()
    )
    return f"""
      SELECT table_id, COALESCE(r_name, a_name) AS column_name,
             CASE WHEN a_name IS NULL THEN 'ONLY_REGISTERED' WHEN r_name IS NULL THEN 'ONLY_ACTUAL'
                  WHEN {' OR '.join(differs.values())} THEN 'MISMATCH' ELSE 'SAME' END AS status,
             CASE WHEN a_name IS NULL OR r_name IS NULL THEN '' ELSE concat_ws('; ', {messages}) END AS message
      FROM paired
    """


FIXTURES["drift"] = drift_sql("column_type", "length", "nullable", "position")


def _catalogs(spark, sf_dir):
    return fixture(spark, sf_dir, "registered"), fixture(spark, sf_dir, "actual")


@query("SELECT * FROM drift")
def catalog_drift(spark, sf_dir):
    return catalog.compare_catalogs(*_catalogs(spark, sf_dir))


@query(drift_sql("column_type", "length", "position"))
def catalog_drift_three_facets(spark, sf_dir):
    return catalog.compare_catalogs(*_catalogs(spark, sf_dir), facets=["column_type", "length", "position"])


@query("""
  SELECT table_id, count(*) FILTER (status <> 'ONLY_REGISTERED') AS total_actual,
         count(*) FILTER (status <> 'ONLY_ACTUAL') AS total_registered,
         count(*) FILTER (status = 'ONLY_ACTUAL') AS added_count,
         count(*) FILTER (status = 'ONLY_REGISTERED') AS removed_count,
         count(*) FILTER (status = 'MISMATCH') AS changed_count, count(*) FILTER (status = 'SAME') AS unchanged_count
  FROM drift GROUP BY table_id
""")
def catalog_drift_summary(spark, sf_dir):
    return catalog.drift_summary(catalog.compare_catalogs(*_catalogs(spark, sf_dir)))


CHANGED_TLN = "(r_type IS DISTINCT FROM a_type OR r_len IS DISTINCT FROM a_len OR r_null IS DISTINCT FROM a_null)"
CHANGED_TLP = "(r_type IS DISTINCT FROM a_type OR r_len IS DISTINCT FROM a_len OR r_pos IS DISTINCT FROM a_pos)"
INSERTED = """
  UNION ALL BY NAME
  SELECT (SELECT max(column_id) FROM registered) + ROW_NUMBER() OVER (ORDER BY table_id, a_pos, a_name) AS column_id,
         table_id, a_name AS column_name, a_pos AS position, a_type AS column_type, a_len AS length,
         a_null AS nullable, 'INSERTED' AS sync_action
  FROM paired WHERE r_name IS NULL
"""


@query(f"""
  SELECT column_id, table_id, r_name AS column_name, r_pos AS position,
         CASE WHEN a_name IS NULL AND r_type NOT LIKE '%[DELETED]%' THEN r_type || ' [DELETED]'
              WHEN a_name IS NULL THEN r_type ELSE a_type END AS column_type,
         CASE WHEN a_name IS NULL THEN r_len ELSE a_len END AS length,
         CASE WHEN a_name IS NULL THEN r_null ELSE a_null END AS nullable,
         CASE WHEN a_name IS NULL AND r_type NOT LIKE '%[DELETED]%' THEN 'DELETED' WHEN a_name IS NULL THEN 'KEPT'
              WHEN {CHANGED_TLN} THEN 'UPDATED' ELSE 'KEPT' END AS sync_action
  FROM paired WHERE r_name IS NOT NULL {INSERTED}
""")
def catalog_sync_soft(spark, sf_dir):
    return catalog.sync_catalog(*_catalogs(spark, sf_dir), mode=catalog.SOFT)


@query(f"""
  SELECT column_id, table_id, r_name AS column_name, a_pos AS position, a_type AS column_type, a_len AS length,
         r_null AS nullable, CASE WHEN {CHANGED_TLP} THEN 'UPDATED' ELSE 'KEPT' END AS sync_action
  FROM paired WHERE r_name IS NOT NULL AND a_name IS NOT NULL {INSERTED}
""")
def catalog_sync_hard(spark, sf_dir):
    return catalog.sync_catalog(*_catalogs(spark, sf_dir), mode=catalog.HARD)


@query(f"""
  SELECT column_id, table_id, r_name AS column_name, r_pos AS position,
         CASE WHEN a_name IS NULL THEN r_type ELSE a_type END AS column_type,
         CASE WHEN a_name IS NULL THEN r_len ELSE a_len END AS length,
         CASE WHEN a_name IS NULL THEN r_null ELSE a_null END AS nullable,
         CASE WHEN a_name IS NOT NULL AND {CHANGED_TLN} THEN 'UPDATED' ELSE 'KEPT' END AS sync_action
  FROM paired WHERE r_name IS NOT NULL
""")
def catalog_sync_update_only(spark, sf_dir):
    return catalog.sync_catalog(*_catalogs(spark, sf_dir), mode=catalog.UPDATE_ONLY)


FIXTURES["dictionary"] = """
  SELECT concat('DB_', CAST(p_size AS STRING)) AS db_name,
         concat(upper(p_name), '_', CAST(p_partkey AS STRING), CASE WHEN p_brand = 'Brand#1' THEN '_NEW' ELSE '' END) AS table_name,
         CASE p_type WHEN 'PROMO' THEN 'P' WHEN 'SMALL' THEN 'V' ELSE 'T' END AS table_kind,
         CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS comment_string
  FROM part
"""


@query("""
  SELECT x.db_name, x.table_name, x.table_kind, COALESCE(x.comment_string, '') AS comment_string,
         CASE WHEN m.table_id IS NOT NULL THEN 'Y' ELSE 'N' END AS in_meta
  FROM dictionary x LEFT JOIN dbs d ON d.database_name = x.db_name
  LEFT JOIN tables m ON m.table_name = x.table_name AND m.database_id = d.database_id
  WHERE x.table_kind IN ('T', 'V')
""")
def registration_candidates(spark, sf_dir):
    return catalog.candidates(*[fixture(spark, sf_dir, n) for n in ("dictionary", "tables", "dbs")])


@query("""
  SELECT l.layer_id, l.layer_name, l.layer_sequence, count(d.database_id) AS database_count
  FROM layers l LEFT JOIN dbs d ON l.layer_id = d.layer_id GROUP BY ALL
""")
def databases_per_layer(spark, sf_dir):
    return catalog.database_counts(fixture(spark, sf_dir, "layers"), fixture(spark, sf_dir, "dbs"))


@query("""
  SELECT d.database_id, d.database_name, d.layer_id, l.layer_name, l.layer_sequence, count(t.table_id) AS table_count
  FROM dbs d JOIN layers l ON d.layer_id = l.layer_id LEFT JOIN tables t ON t.database_id = d.database_id GROUP BY ALL
""")
def tables_per_database(spark, sf_dir):
    return catalog.table_counts(*[fixture(spark, sf_dir, n) for n in ("dbs", "layers", "tables")])


@query("""
  SELECT t.table_id, t.table_name, count(r.column_id) AS column_count
  FROM tables t LEFT JOIN registered r ON r.table_id = t.table_id GROUP BY ALL
""")
def columns_per_table(spark, sf_dir):
    counted = catalog.column_counts(fixture(spark, sf_dir, "tables"), fixture(spark, sf_dir, "registered"))
    return counted.select("table_id", "table_name", "column_count")


@query("""
  SELECT t.table_id, t.table_name, d.database_name FROM tables t JOIN dbs d ON t.database_id = d.database_id
  WHERE t.layer_id = 2 AND (upper(t.table_name) LIKE '%BOLT_1%' OR upper(t.comment_string) LIKE '%BOLT_1%')
""")
def table_search(spark, sf_dir):
    tables, dbs = fixture(spark, sf_dir, "tables"), fixture(spark, sf_dir, "dbs")
    found = catalog.search_tables(tables, dbs, search="bolt_1", layer_id=2)
    return found.select("table_id", "table_name", "database_name")


@query("""
  SELECT t.table_id, t.comment_string FROM tables t JOIN dbs d ON t.database_id = d.database_id
  WHERE d.database_name = 'DB_7' AND (upper(t.table_name) LIKE '%BRAND#1%' OR upper(t.comment_string) LIKE '%BRAND#1%')
""")
def table_search_by_comment(spark, sf_dir):
    tables, dbs = fixture(spark, sf_dir, "tables"), fixture(spark, sf_dir, "dbs")
    found = catalog.search_tables(tables, dbs, search="Brand#1", database_name="DB_7")
    return found.select("table_id", "comment_string")


FIXTURES["searches"] = """
  SELECT lower(p_type) AS search FROM part UNION SELECT p_brand FROM part UNION SELECT lower(RIGHT(p_name, 4)) FROM part
"""


@query("""
  SELECT s.search, t.table_id, t.table_name, d.database_name
  FROM searches s JOIN tables t ON upper(t.table_name) LIKE '%' || upper(s.search) || '%'
    OR upper(t.comment_string) LIKE '%' || upper(s.search) || '%'
  JOIN dbs d ON t.database_id = d.database_id
""")
def table_search_of_many(spark, sf_dir):
    tables, dbs, searches = (fixture(spark, sf_dir, n) for n in ("tables", "dbs", "searches"))
    return catalog.search_many(tables, dbs, searches).select("search", "table_id", "table_name", "database_name")


FIXTURES["named_tables"] = """
  SELECT p_partkey, concat(CASE p_type WHEN 'PROMO' THEN 'TAAA_' WHEN 'SMALL' THEN 'zas_' WHEN 'LARGE' THEN 'taas_'
         WHEN 'ECONOMY' THEN 'ABCDE_' WHEN 'STANDARD' THEN 'X1_' ELSE '' END, upper(replace(p_name, ' ', '_'))) AS table_name
  FROM part
"""


@query("""
  SELECT p_partkey, table_name, CASE
    WHEN upper(left(table_name, 5)) IN ('TAAA_', 'TAAS_') THEN substr(table_name, 6)
    WHEN upper(left(table_name, 4)) IN ('TAA_', 'ZAS_') THEN substr(table_name, 5)
    WHEN strpos(table_name, '_') BETWEEN 1 AND 5 THEN substr(table_name, strpos(table_name, '_') + 1)
    ELSE table_name END AS core_name
  FROM named_tables
""")
def core_names(spark, sf_dir):
    t = fixture(spark, sf_dir, "named_tables")
    return t.withColumn("core_name", core_name(F.col("table_name"), CORE_PREFIXES))


# One type code per part brand; sizes, precisions and scales from other columns.
FIXTURES["typed_columns"] = """
  SELECT p_partkey,
         CASE p_brand WHEN 'Brand#1' THEN 'I8 ' WHEN 'Brand#2' THEN 'CV' WHEN 'Brand#3' THEN 'cf' WHEN 'Brand#4' THEN 'D'
           WHEN 'Brand#5' THEN 'DA' WHEN 'Brand#6' THEN 'TS' WHEN 'Brand#7' THEN 'BV' WHEN 'Brand#8' THEN 'N '
           WHEN 'Brand#9' THEN 'DS' WHEN 'Brand#10' THEN 'VARCHAR(30)' WHEN 'Brand#11' THEN 'TIMESTAMP(26)'
           WHEN 'Brand#12' THEN 'TIMESTAMP(3)' WHEN 'Brand#13' THEN 'integer' WHEN 'Brand#14' THEN 'TZ'
           WHEN 'Brand#15' THEN 'BO' WHEN 'Brand#16' THEN NULL WHEN 'Brand#17' THEN 'PM' WHEN 'Brand#18' THEN 'SZ'
           ELSE 'QQ' END AS code,
         CASE WHEN p_size < 10 THEN NULL ELSE p_size END AS length,
         CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS precision_digits,
         CASE WHEN p_size > 30 THEN NULL WHEN p_size < 5 THEN 0 ELSE 3 END AS scale_digits
  FROM part
"""


@query("""
  SELECT p_partkey, code, CASE upper(trim(COALESCE(code, '')))
    WHEN 'I8' THEN 'BIGINT' WHEN 'CV' THEN 'VARCHAR(' || COALESCE(length, 255) || ') CHARACTER SET UNICODE'
    WHEN 'CF' THEN 'CHAR(' || COALESCE(length, 1) || ') CHARACTER SET UNICODE'
    WHEN 'D' THEN 'DECIMAL(' || COALESCE(precision_digits, 18) || ',' || COALESCE(scale_digits, 2) || ')'
    WHEN 'N' THEN 'DECIMAL(' || COALESCE(precision_digits, 18) || ',' || COALESCE(scale_digits, 2) || ')'
    WHEN 'DA' THEN 'DATE' WHEN 'TS' THEN 'TIMESTAMP(6)' WHEN 'BV' THEN 'VARBYTE(' || COALESCE(length, 64000) || ')'
    WHEN 'DS' THEN 'INTERVAL DAY TO SECOND' WHEN 'VARCHAR(30)' THEN 'VARCHAR(30) CHARACTER SET UNICODE'
    WHEN 'TIMESTAMP(26)' THEN 'TIMESTAMP(' || COALESCE(scale_digits, 6) || ')' WHEN 'TIMESTAMP(3)' THEN 'TIMESTAMP(3)'
    WHEN 'INTEGER' THEN 'INTEGER' WHEN 'TZ' THEN 'TIME WITH TIME ZONE' WHEN 'BO' THEN 'BLOB'
    WHEN 'PM' THEN 'PERIOD(TIMESTAMP)' WHEN 'SZ' THEN 'TIMESTAMP WITH TIME ZONE'
    ELSE 'VARCHAR(255) CHARACTER SET UNICODE' END AS type_name
  FROM typed_columns
""")
def catalog_type_names(spark, sf_dir):
    c = fixture(spark, sf_dir, "typed_columns")
    name = type_name(*[F.col(x) for x in ("code", "length", "precision_digits", "scale_digits")])
    return c.select("p_partkey", "code", name.alias("type_name"))


@query("""
  SELECT p_partkey, CASE trim(COALESCE(code, ''))
    WHEN 'I8' THEN 'BIGINT' WHEN 'CV' THEN 'VARCHAR' || COALESCE('(' || length || ')', '') WHEN 'cf' THEN 'cf'
    WHEN 'D' THEN 'DECIMAL' || COALESCE('(' || precision_digits || CASE WHEN scale_digits > 0 THEN ',' || scale_digits ELSE '' END || ')', '')
    WHEN 'N' THEN 'NUMBER' || COALESCE('(' || precision_digits || CASE WHEN scale_digits > 0 THEN ',' || scale_digits ELSE '' END || ')', '')
    WHEN 'DA' THEN 'DATE' WHEN 'TS' THEN 'TIMESTAMP' || COALESCE('(' || scale_digits || ')', '')
    WHEN 'BV' THEN 'VARBYTE' || COALESCE('(' || length || ')', '') WHEN 'DS' THEN 'INTERVAL DAY TO SECOND'
    WHEN 'TZ' THEN 'TIME WITH TIME ZONE' || COALESCE('(' || scale_digits || ')', '') WHEN 'BO' THEN 'BLOB'
    WHEN 'SZ' THEN 'TIMESTAMP WITH TIME ZONE' || COALESCE('(' || scale_digits || ')', '')
    ELSE trim(COALESCE(code, '')) END AS display_type
  FROM typed_columns
""")
def dictionary_type_names(spark, sf_dir):
    c = fixture(spark, sf_dir, "typed_columns")
    shown = dictionary_type(*[F.col(x) for x in ("code", "length", "precision_digits", "scale_digits")])
    return c.select("p_partkey", shown.alias("display_type"))


FIXTURES["foreign_columns"] = """
  SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'NVarChar' WHEN 'SMALL' THEN 'int' WHEN 'LARGE' THEN 'decimal'
           WHEN 'ECONOMY' THEN 'datetime2' WHEN 'STANDARD' THEN 'text' ELSE 'geography' END AS source_datatype,
         CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN -1 ELSE p_size * 1000 END AS max_length,
         CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS precision, CASE WHEN p_size > 25 THEN NULL ELSE 4 END AS scale
  FROM part
"""
# Rules keyed by the part types that occur, the later rule of a type being inactive or unused.
FIXTURES["type_rules"] = """
  SELECT DISTINCT 1 AS rule_id, 'nvarchar' AS source_datatype, 'Y' AS is_active, 'VARCHAR' AS target_datatype, 3 AS multiplier,
         32000 AS target_max_length, CAST(NULL AS INT) AS target_precision, CAST(NULL AS INT) AS target_scale,
         '{base}({length})' AS type_format, CAST(NULL AS STRING) AS convert_template FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT DISTINCT 2, 'nvarchar', 'Y', 'CLOB', 1, NULL, NULL, NULL, '{base}', NULL FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT DISTINCT 3, 'int', 'Y', 'INTEGER', NULL, NULL, NULL, NULL, '{base}', NULL FROM part WHERE p_type = 'SMALL'
  UNION ALL SELECT DISTINCT 4, 'decimal', 'Y', 'DECIMAL', 1, NULL, 18, 2, '{base}({precision},{scale})', NULL FROM part WHERE p_type = 'LARGE'
  UNION ALL SELECT DISTINCT 5, 'datetime2', 'N', 'DATE', 1, NULL, NULL, NULL, '{base}', NULL FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT DISTINCT 6, 'datetime2', 'Y', 'TIMESTAMP', 1, 5, NULL, NULL, '{base}({precision})', 'CONVERT(VARCHAR({len}), [{col}])' FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT DISTINCT 7, 'text', 'Y', 'VARCHAR', 2, NULL, NULL, NULL, '{base}({length})', NULL FROM part WHERE p_type = 'STANDARD'
"""


@query("""
  SELECT p_partkey, source_datatype, max_length, precision, scale,
         CASE source_datatype
           WHEN 'NVarChar' THEN 'VARCHAR(' || CASE WHEN max_length > 0 THEN least(max_length * 3, 32000) ELSE 32000 END || ')'
           WHEN 'int' THEN 'INTEGER'
           WHEN 'decimal' THEN 'DECIMAL(' || COALESCE(precision, 18) || ',' || COALESCE(scale, 2) || ')'
           WHEN 'datetime2' THEN 'TIMESTAMP(' || COALESCE(precision, 5) || ')'
           WHEN 'text' THEN 'VARCHAR(' || CASE WHEN max_length > 0 THEN least(max_length * 2, 64000) ELSE 0 END || ')'
           ELSE 'VARCHAR(255)' END AS target_type,
         CASE source_datatype WHEN 'NVarChar' THEN 3 WHEN 'text' THEN 2 ELSE 1 END AS multiplier,
         CASE source_datatype WHEN 'datetime2' THEN 'CONVERT(VARCHAR({len}), [{col}])' END AS convert_template
  FROM foreign_columns
""")
def mapped_source_types(spark, sf_dir):
    return catalog.map_source_types(fixture(spark, sf_dir, "foreign_columns"), fixture(spark, sf_dir, "type_rules"))

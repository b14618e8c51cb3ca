"""Loads: keys, lookups, SCD-2, merge, ingest, statistics."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samples.support import (
    CTX,
    FIXTURES,
    RUN_TS,
    fixture,
    hash_sql,
    hex_text,
    portable,
    query,
    table,
    ts_sql,
    ts_text,
)
from sedimenta.config import BridgeLookup, KeyLookup, LoadSpec, MasterLookup, Scd2Config
from sedimenta.functions.text import key_hash, natural_key, record_hash
from sedimenta.operators import foreign_keys, ingest, merge, scd2, stats, surrogate
from sedimenta.operators.ingest import ColumnMapping
from sedimenta.plans.load import LoadCounts, load_delta, load_history, load_with_log, read_runs, read_steps
from sedimenta.sources.tables import scan_view, select_columns
from sedimenta.sources.bucketed import BucketedTable
from sedimenta.sources.versioned import VersionedTable
from sedimenta.sources.workspace import folder, stash

# A batch with null keys, exact duplicates and one key with two contents.
FIXTURES["batch"] = """
  SELECT CASE WHEN c_acctbal < -900 THEN NULL ELSE c_custkey END AS c_custkey,
         c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9900
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'RETAIL' AS c_mktsegment
  FROM customer WHERE c_acctbal > 9800 AND c_acctbal <= 9900
"""

# Versions before their hash: current ones (two nations missing, one segment outdated), closed
# ones, second current rows of a key, and rows whose flag is neither current nor closed.
FIXTURES["versions"] = """
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'OLD' ELSE c_mktsegment END AS c_mktsegment,
         CAST('2023-06-01 00:00:00' AS $TS) AS VALID_FROM,
         CAST('9999-12-31 23:59:59.999999' AS $TS) AS VALID_TO, 'Y' AS IS_CURRENT
  FROM customer WHERE c_nationkey NOT IN (3, 7)
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'FIRST' AS c_mktsegment,
         CAST('2023-01-01 00:00:00' AS $TS) AS VALID_FROM,
         CAST('2023-06-01 00:00:00' AS $TS) AS VALID_TO, 'N' AS IS_CURRENT
  FROM customer WHERE c_nationkey < 5
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'SECOND' AS c_mktsegment,
         CAST('2023-07-01 00:00:00' AS $TS) AS VALID_FROM,
         CAST('9999-12-31 23:59:59.999999' AS $TS) AS VALID_TO, 'Y' AS IS_CURRENT
  FROM customer WHERE c_nationkey = 20
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'ODD' AS c_mktsegment,
         CAST('2023-05-01 00:00:00' AS $TS) AS VALID_FROM,
         CAST('2023-05-02 00:00:00' AS $TS) AS VALID_TO, 'X' AS IS_CURRENT
  FROM customer WHERE c_nationkey > 21
"""

# Key table of customers with a non-negative balance; keys leave gaps.
FIXTURES["customer_keys"] = """
  SELECT c_custkey * 2 + 10 AS SURROGATE_KEY, CAST(c_custkey AS STRING) AS NATURAL_KEY_VALUE,
         'SALES' AS NATURAL_KEY_DOMAIN
  FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT c_custkey AS SURROGATE_KEY, CAST(c_custkey AS STRING) AS NATURAL_KEY_VALUE,
         'OTHER' AS NATURAL_KEY_DOMAIN
  FROM customer
"""

FIXTURES["order_keys"] = """
  SELECT o_orderkey AS SURROGATE_KEY, CAST(o_orderkey AS STRING) AS NATURAL_KEY_VALUE,
         'SALES' AS NATURAL_KEY_DOMAIN
  FROM orders WHERE o_orderstatus <> 'P'
"""

# Parent history with up to two versions of one surrogate key.
FIXTURES["nation_history"] = """
  SELECT n_nationkey, CAST(n_nationkey + 100 AS BIGINT) AS NATION_SK, n_name, 'Y' AS IS_CURRENT
  FROM nation WHERE n_regionkey <> 4
  UNION ALL
  SELECT n_nationkey, CAST(n_nationkey + 100 AS BIGINT) AS NATION_SK, 'before' AS n_name, 'N' AS IS_CURRENT
  FROM nation WHERE n_regionkey < 3
"""

FIXTURES["customer_view"] = """
  SELECT v.c_custkey, v.c_name, v.c_mktsegment, k.SURROGATE_KEY AS CUSTOMER_KEY,
         v.VALID_FROM, v.VALID_TO, v.IS_CURRENT
  FROM versions v
  LEFT JOIN customer_keys k
    ON k.NATURAL_KEY_VALUE = CAST(v.c_custkey AS STRING) AND k.NATURAL_KEY_DOMAIN = 'SALES'
"""

# Text extract with broken numbers and dates.
FIXTURES["order_extract"] = """
  SELECT CAST(o_orderkey AS STRING) AS order_no,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'n/a'
              ELSE CAST(o_custkey AS STRING) END AS customer_no,
         CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN NULL
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS price,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'not a date'
              ELSE CAST(o_orderdate AS STRING) END AS ordered_at,
         o_orderpriority AS prio
  FROM orders
"""

HASH = hash_sql(c_custkey="text", c_name="text", c_nationkey="text", c_acctbal="number", c_mktsegment="text")
BUSINESS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

FIXTURES["history"] = f"""
  SELECT v.*, CASE WHEN c_nationkey = 11 AND c_mktsegment = 'FURNITURE' THEN NULL ELSE {HASH} END AS RECORD_HASH,
         VALID_FROM AS CREATED_TIMESTAMP, VALID_FROM AS LAST_UPDATED_TIMESTAMP,
         'init' AS CREATED_BY, 'init' AS LAST_UPDATED_BY
  FROM versions v
"""
FIXTURES["hashed_batch"] = f"SELECT b.*, {HASH} AS RECORD_HASH FROM batch b"

# The reference statements of a classification, as a second engine runs them.
CLASSIFIED = """
  SELECT b.*,
         CASE WHEN NOT EXISTS (SELECT 1 FROM history h WHERE h.c_custkey = b.c_custkey AND h.IS_CURRENT = 'Y')
              THEN 'NEW'
              WHEN EXISTS (SELECT 1 FROM history h WHERE h.c_custkey = b.c_custkey AND h.IS_CURRENT = 'Y'
                           AND h.RECORD_HASH <> b.RECORD_HASH)
              THEN 'CHANGED' ELSE 'UNCHANGED' END AS action
  FROM hashed_batch b
"""
FIXTURES["classified"] = CLASSIFIED

SPEC = LoadSpec(business_key=["c_custkey"], surrogate=None)
KEYED = replace(SPEC, surrogate="key_table", sk_column="CUSTOMER_SK", domain="SALES")


def history(spark, sf_dir: str, sk: str | None = None) -> DataFrame:
    """The history fixture with hashes made by the library."""
    v = fixture(spark, sf_dir, "versions")
    unknown = (F.col("c_nationkey") == 11) & (F.col("c_mktsegment") == "FURNITURE")
    v = v.withColumn("RECORD_HASH", F.when(~unknown, record_hash(v, BUSINESS)))
    v = v.withColumns(
        {
            "CREATED_TIMESTAMP": F.col("VALID_FROM"),
            "LAST_UPDATED_TIMESTAMP": F.col("VALID_FROM"),
            "CREATED_BY": F.lit("init"),
            "LAST_UPDATED_BY": F.lit("init"),
        }
    )
    return v.withColumn(sk, F.col("c_custkey") + 5000) if sk else v


# --- change classification -------------------------------------------------------------


@query("SELECT action, count(*) AS row_count FROM classified GROUP BY action")
def scd2_action_counts(spark, sf_dir):
    return scd2.action_counts(
        scd2.classify(fixture(spark, sf_dir, "batch"), history(spark, sf_dir), SPEC)
    )


@query("SELECT * FROM classified")
def scd2_classify(spark, sf_dir):
    tagged = scd2.classify(fixture(spark, sf_dir, "batch"), history(spark, sf_dir), SPEC)
    return portable(tagged.withColumnRenamed(scd2.ACTION, "action"))


@query("""
  SELECT b.* FROM batch b LEFT JOIN history h ON b.c_custkey = h.c_custkey AND h.IS_CURRENT = 'Y'
  WHERE h.c_custkey IS NULL
""")
def scd2_new_records(spark, sf_dir):
    return scd2.identify_new(fixture(spark, sf_dir, "batch"), history(spark, sf_dir), SPEC)


@query("""
  SELECT * FROM hashed_batch b
  WHERE EXISTS (SELECT 1 FROM history h WHERE b.c_custkey = h.c_custkey AND h.IS_CURRENT = 'Y'
                AND b.RECORD_HASH <> h.RECORD_HASH)
""")
def scd2_changed_records(spark, sf_dir):
    return portable(scd2.identify_changed(fixture(spark, sf_dir, "batch"), history(spark, sf_dir), SPEC))


@query("""
  SELECT b.c_custkey, b.action FROM classified b WHERE b.c_custkey IS NOT NULL
""")
def scd2_reject_null_keys(spark, sf_dir):
    spec = replace(SPEC, null_keys="reject")
    tagged = scd2.classify(fixture(spark, sf_dir, "batch"), history(spark, sf_dir), spec)
    return tagged.select("c_custkey", F.col(scd2.ACTION).alias("action"))


# --- closing versions ------------------------------------------------------------------

TECHNICAL_SQL = f"""
  {ts_sql('VALID_FROM')}, {ts_sql('VALID_TO')}, {ts_sql('CREATED_TIMESTAMP')},
  {ts_sql('LAST_UPDATED_TIMESTAMP')}, IS_CURRENT, RECORD_HASH, CREATED_BY, LAST_UPDATED_BY
"""


def closed_sql(open_rows: str) -> str:
    """History after closing the open versions of changed keys."""
    hit = f"({open_rows} AND EXISTS (SELECT 1 FROM classified c WHERE c.action = 'CHANGED' AND c.c_custkey = h.c_custkey))"
    now = f"CAST('{RUN_TS}' AS TIMESTAMP)"
    return f"""
      SELECT h.c_custkey, h.c_name, h.c_nationkey, h.c_acctbal, h.c_mktsegment, h.VALID_FROM,
             CASE WHEN {hit} THEN {now} ELSE h.VALID_TO END AS VALID_TO,
             CASE WHEN {hit} THEN 'N' ELSE h.IS_CURRENT END AS IS_CURRENT,
             h.RECORD_HASH, h.CREATED_TIMESTAMP,
             CASE WHEN {hit} THEN {now} ELSE h.LAST_UPDATED_TIMESTAMP END AS LAST_UPDATED_TIMESTAMP,
             h.CREATED_BY, CASE WHEN {hit} THEN 'etl' ELSE h.LAST_UPDATED_BY END AS LAST_UPDATED_BY
      FROM history h
    """


FIXTURES["closed_history"] = closed_sql("h.IS_CURRENT = 'Y'")
FIXTURES["closed_any"] = closed_sql("h.IS_CURRENT <> 'N'")
CUSTOMER_SQL = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _close(spark, sf_dir, mode: str) -> DataFrame:
    spec = replace(SPEC, close_mode=mode)
    h = history(spark, sf_dir)
    changed = scd2.identify_changed(fixture(spark, sf_dir, "batch"), h, spec)
    return portable(scd2.close_versions(h, changed, spec, CTX))


@query(f"SELECT {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM closed_history")
def scd2_close_current(spark, sf_dir):
    return _close(spark, sf_dir, "current")


@query(f"SELECT {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM closed_any")
def scd2_close_not_closed(spark, sf_dir):
    return _close(spark, sf_dir, "not_closed")


# --- whole SCD-2 loads -----------------------------------------------------------------


def inserted_sql(keys: str = "", joins: str = "", source: str = "classified", where: str = "action <> 'UNCHANGED'") -> str:
    now = f"CAST('{RUN_TS}' AS TIMESTAMP)"
    return f"""
      SELECT DISTINCT {keys} b.c_custkey, b.c_name, b.c_nationkey, b.c_acctbal, b.c_mktsegment,
             {now} AS VALID_FROM, CAST('9999-12-31 23:59:59.999999' AS TIMESTAMP) AS VALID_TO,
             'Y' AS IS_CURRENT, b.RECORD_HASH, {now} AS CREATED_TIMESTAMP,
             {now} AS LAST_UPDATED_TIMESTAMP, 'etl' AS CREATED_BY, 'etl' AS LAST_UPDATED_BY
      FROM {source} b {joins} WHERE {where}
    """


@query(f"""
  WITH result AS (SELECT * FROM closed_history UNION ALL BY NAME {inserted_sql()})
  SELECT {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM result
""")
def scd2_apply_without_key(spark, sf_dir):
    return portable(
        scd2.apply(history(spark, sf_dir), fixture(spark, sf_dir, "batch"), SPEC, CTX).history
    )


KEY_JOIN = """
  LEFT JOIN customer_keys k ON k.NATURAL_KEY_VALUE = CAST(b.c_custkey AS VARCHAR) AND k.NATURAL_KEY_DOMAIN = 'SALES'
  LEFT JOIN (SELECT DISTINCT n_nationkey, NATION_SK FROM nation_history) n
    ON CAST(n.n_nationkey AS VARCHAR) = CAST(b.c_nationkey AS VARCHAR)
"""
BOTH_KEYS = "COALESCE(k.SURROGATE_KEY, -1) AS CUSTOMER_SK, COALESCE(n.NATION_SK, -1) AS NATION_SK_FK,"


def _nation_fk(spark, sf_dir) -> MasterLookup:
    return MasterLookup(
        "NATION_SK_FK", "c_nationkey", fixture(spark, sf_dir, "nation_history"), "n_nationkey", "NATION_SK"
    )


@query(f"""
  WITH result AS (
    SELECT c_custkey + 5000 AS CUSTOMER_SK, CAST(-1 AS BIGINT) AS NATION_SK_FK, * FROM closed_history
    UNION ALL BY NAME {inserted_sql(BOTH_KEYS, KEY_JOIN)})
  SELECT CUSTOMER_SK, NATION_SK_FK, {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM result
""")
def scd2_apply_with_keys(spark, sf_dir):
    spec = replace(KEYED, foreign_keys=[_nation_fk(spark, sf_dir)])
    before = history(spark, sf_dir, "CUSTOMER_SK").withColumn("NATION_SK_FK", F.lit(-1).cast("long"))
    keys = fixture(spark, sf_dir, "customer_keys")
    result = scd2.apply(before, fixture(spark, sf_dir, "batch"), spec, CTX, keys)
    return portable(result.history)


@query(f"""
  WITH result AS ({inserted_sql(BOTH_KEYS, KEY_JOIN, 'hashed_batch', 'TRUE')})
  SELECT CUSTOMER_SK, NATION_SK_FK, {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM result
""")
def scd2_full_reload(spark, sf_dir):
    spec = replace(KEYED, foreign_keys=[_nation_fk(spark, sf_dir)])
    before = history(spark, sf_dir, "CUSTOMER_SK").withColumn("NATION_SK_FK", F.lit(-1).cast("long"))
    keys = fixture(spark, sf_dir, "customer_keys")
    result = scd2.full_reload(before, fixture(spark, sf_dir, "batch"), spec, CTX, keys)
    return portable(result.history)


VIEW_FLAGS = Scd2Config(
    valid_from="ACTIVE_FROM", valid_to="ACTIVE_TO", current_flag="ACTIVE_FLAG", current_value="J", closed_value="N"
)


@query(f"""
  WITH result AS (
    SELECT c_custkey + 5000 AS CUSTOMER_SK, * FROM closed_any
    UNION ALL BY NAME {inserted_sql('b.c_custkey + 5000 AS CUSTOMER_SK,')})
  SELECT CUSTOMER_SK, {CUSTOMER_SQL}, {ts_sql('VALID_FROM', 'ACTIVE_FROM')}, {ts_sql('VALID_TO', 'ACTIVE_TO')},
         {ts_sql('CREATED_TIMESTAMP')}, {ts_sql('LAST_UPDATED_TIMESTAMP')},
         CASE IS_CURRENT WHEN 'Y' THEN 'J' ELSE IS_CURRENT END AS ACTIVE_FLAG,
         RECORD_HASH, CREATED_BY, LAST_UPDATED_BY
  FROM result
""")
def scd2_apply_keys_from_view(spark, sf_dir):
    spec = LoadSpec(
        business_key=["c_custkey"], columns=BUSINESS, surrogate="staging", sk_column="CUSTOMER_SK",
        scd2=VIEW_FLAGS, close_mode="not_closed",
    )
    h = history(spark, sf_dir, "CUSTOMER_SK").withColumnsRenamed(
        {"VALID_FROM": "ACTIVE_FROM", "VALID_TO": "ACTIVE_TO", "IS_CURRENT": "ACTIVE_FLAG"}
    )
    flag = F.col("ACTIVE_FLAG")
    h = h.withColumn("ACTIVE_FLAG", F.when(flag == "Y", "J").otherwise(flag))
    batch = fixture(spark, sf_dir, "batch").withColumn("CUSTOMER_SK", F.col("c_custkey") + 5000)
    return portable(scd2.apply(h, batch, spec, CTX).history)


# --- loads as they are stored ------------------------------------------------------------


def _bucketed(spark, sf_dir, **kw) -> BucketedTable:
    before = history(spark, sf_dir)
    target = BucketedTable(folder(spark, "buckets"), before.schema, ["c_custkey"], **kw)
    target.adopt(before, scd2.open_rows(before, SPEC))
    return target


DELTA = f"""
  WITH result AS (SELECT * FROM closed_history UNION ALL BY NAME {inserted_sql()})
  SELECT {CUSTOMER_SQL}, {TECHNICAL_SQL} FROM result
"""


@query(DELTA)
def scd2_delta_published(spark, sf_dir):
    """A batch applied twice to a table in buckets: the second run finds the first one through."""
    target = _bucketed(spark, sf_dir, buckets=16)
    for _ in range(2):
        load_delta(spark, fixture(spark, sf_dir, "batch"), target, SPEC, CTX)
    return portable(target.read(spark))


@query(DELTA)
def scd2_delta_published_by_ranges(spark, sf_dir):
    target = _bucketed(spark, sf_dir, buckets=20, width=50)
    load_delta(spark, fixture(spark, sf_dir, "batch"), target, SPEC, CTX)
    return portable(target.read(spark))


COUNTS = f"""
  (SELECT count(*) FROM batch) AS rows_read, (SELECT count(*) FROM ({inserted_sql()})) AS rows_inserted,
  (SELECT count(*) FROM history h WHERE IS_CURRENT = 'Y' AND EXISTS (
     SELECT 1 FROM classified c WHERE c.action = 'CHANGED' AND c.c_custkey = h.c_custkey)) AS rows_updated
"""


@query(f"SELECT {COUNTS}")
def load_history_counts(spark, sf_dir):
    """What a load that publishes a whole version reports."""
    before = history(spark, sf_dir)
    target = VersionedTable(folder(spark, "history"), before.schema)
    target.publish(before.withColumn(scd2.CLOSED_NOW, ~scd2.open_rows(before, SPEC)))
    counts = load_history(spark, fixture(spark, sf_dir, "batch"), target, SPEC, CTX)
    return spark.createDataFrame(
        [(counts.rows_read, counts.rows_inserted, counts.rows_updated)], "rows_read long, rows_inserted long, rows_updated long"
    )


def _logged_load(spark, sf_dir) -> str:
    """Two steps; the first attempt breaks in the second one, the next attempt goes on there."""
    log, target = folder(spark, "log"), _bucketed(spark, sf_dir, buckets=16)
    ticks = (datetime.fromisoformat(RUN_TS) + timedelta(seconds=s) for s in range(60))
    attempts = []

    def load() -> LoadCounts:
        return load_delta(spark, fixture(spark, sf_dir, "batch"), target, SPEC, CTX)

    def count() -> LoadCounts:
        attempts.append(1)
        if len(attempts) == 1:
            raise RuntimeError("interrupted")
        return LoadCounts(rows_read=target.read(spark).count())

    for _ in range(3):
        try:
            load_with_log(spark, log, CTX.run_id, 10, [(100, load), (101, count)], now=lambda: next(ticks))
        except RuntimeError:
            pass
    return log


STEP_TIMES = "'2024-02-01 00:00:{}.000000'"


@query(f"""
  SELECT 7 AS run_id, 100 AS step_id, 7 * 1048576 + 1 AS step_run_id, 'SUCCESS' AS status, {STEP_TIMES.format('01')} AS start_time,
         {STEP_TIMES.format('02')} AS end_time, CAST(1 AS DECIMAL(18,6)) AS duration_seconds, {COUNTS}
  UNION ALL
  SELECT 7, 101, 7 * 1048576 + 2, 'SUCCESS', {STEP_TIMES.format('07')}, {STEP_TIMES.format('08')}, 1,
         (SELECT count(*) FROM closed_history) + (SELECT count(*) FROM ({inserted_sql()})), 0, 0
""")
def load_with_log_steps(spark, sf_dir):
    steps = read_steps(spark, _logged_load(spark, sf_dir))
    names = ["run_id", "step_id", "step_run_id", "status", "start_time", "end_time", "duration_seconds"]
    return portable(steps.select(*names, "rows_read", "rows_inserted", "rows_updated"))


@query(f"""
  SELECT 7 AS run_id, 10 AS job_id, 'SUCCESS' AS status, {STEP_TIMES.format('06')} AS start_time, {STEP_TIMES.format('09')} AS end_time,
         CAST(3 AS DECIMAL(18,6)) AS duration_seconds, 'DELTA' AS execution_mode
""")
def load_with_log_run(spark, sf_dir):
    runs = read_runs(spark, _logged_load(spark, sf_dir))
    names = ["run_id", "job_id", "status", "start_time", "end_time", "duration_seconds", "execution_mode"]
    return portable(runs.select(*names))


@query("""
  SELECT c_custkey, count(*) AS row_count FROM batch GROUP BY c_custkey HAVING count(*) > 1
""")
def batch_duplicate_keys(spark, sf_dir):
    return scd2.duplicate_keys(fixture(spark, sf_dir, "batch"), ["c_custkey"])


# --- surrogate keys --------------------------------------------------------------------


def _key_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "SURROGATE_KEY", "NATURAL_KEY_VALUE", "NATURAL_KEY_DOMAIN", hex_text("NATURAL_KEY_HASH"),
        ts_text("CREATED_TIMESTAMP"), "CREATED_BY",
    )


def key_rows_sql(natural: str, source: str, top: str, known: str, domain: str, creator: str) -> str:
    return f"""
      SELECT {top} + DENSE_RANK() OVER (ORDER BY nk) AS SURROGATE_KEY, nk AS NATURAL_KEY_VALUE,
             '{domain}' AS NATURAL_KEY_DOMAIN, sha256(nk) AS NATURAL_KEY_HASH,
             '{RUN_TS}.000000' AS CREATED_TIMESTAMP, '{creator}' AS CREATED_BY
      FROM (SELECT DISTINCT {natural} AS nk FROM {source}) s
      WHERE nk IS NOT NULL AND nk NOT IN ({known})
    """


KNOWN = "SELECT NATURAL_KEY_VALUE FROM customer_keys WHERE NATURAL_KEY_DOMAIN = 'SALES'"
TOP = "(SELECT COALESCE(MAX(SURROGATE_KEY), 0) FROM customer_keys)"


@query(key_rows_sql("CAST(c_custkey AS VARCHAR)", "batch", TOP, KNOWN, "SALES", "ETL_KEY_GEN_SALES"))
def surrogate_keys_after_existing(spark, sf_dir):
    keys = fixture(spark, sf_dir, "customer_keys")
    batch = fixture(spark, sf_dir, "batch")
    return _key_rows(surrogate.generate_surrogate_keys(batch, keys, ["c_custkey"], "SALES", CTX))


@query(key_rows_sql("CAST(o_orderkey AS VARCHAR)", "orders", "-1", "'UNKNOWN'", "SALES", "ETL_KEY_GEN"))
def surrogate_keys_from_source_seeded(spark, sf_dir):
    keys = surrogate.ensure_key_table(spark, CTX, seed=True)
    source = table(spark, sf_dir, "orders")
    fresh = surrogate.generate_surrogate_keys(
        source, keys, ["o_orderkey"], "SALES", CTX, from_staging=False
    )
    return _key_rows(fresh)


@query(
    key_rows_sql(
        "TRIM(LEFT(CAST(l_orderkey AS VARCHAR), 100)) || '~|~' || TRIM(LEFT(CAST(l_linenumber AS VARCHAR), 100))",
        "lineitem", "0", "'UNKNOWN'", "LINES", "ETL_KEY_GEN_LINES",
    )
)
def surrogate_keys_composite(spark, sf_dir):
    keys = surrogate.ensure_key_table(spark, CTX, seed=False)
    source = table(spark, sf_dir, "lineitem")
    return _key_rows(
        surrogate.generate_surrogate_keys(source, keys, ["l_orderkey", "l_linenumber"], "LINES", CTX)
    )


@query("SELECT DISTINCT text, DENSE_RANK() OVER (ORDER BY text) AS position FROM documents WHERE text IS NOT NULL")
def distinct_text_positions(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text").filter(F.col("text").isNotNull()).distinct()
    return surrogate.number_distinct(texts, "text")


@query("""
  SELECT conv_id, turn,
         TRIM(LEFT(CAST(conv_id AS VARCHAR), 100)) || '~|~' || TRIM(LEFT(CAST(turn AS VARCHAR), 100)) || '~|~'
           || TRIM(LEFT(text, 100)) AS natural_key,
         LEFT(text, 255) AS single_key, sha256(LEFT(text, 255)) AS key_hash
  FROM conversations
""")
def natural_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    single = natural_key(c, ["text"], cut=True)
    return c.select(
        "conv_id", "turn", natural_key(c, ["conv_id", "turn", "text"], cut=True).alias("natural_key"),
        single.alias("single_key"), F.lower(F.hex(key_hash(single))).alias("key_hash"),
    )


@query("""
  SELECT conv_id, turn, text AS single_key,
         trim(CAST(conv_id AS VARCHAR)) || '~|~' || CAST(turn AS VARCHAR) || '~|~' || trim(text) AS natural_key
  FROM conversations
""")
def natural_keys_whole(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parts = natural_key(c, ["conv_id", "turn", "text"]).alias("natural_key")
    return c.select("conv_id", "turn", natural_key(c, ["text"]).alias("single_key"), parts)


# --- record hashes ---------------------------------------------------------------------

ORDER_HASH = hash_sql(
    o_orderkey="text", o_custkey="text", o_orderstatus="text", o_totalprice="number", o_orderdate="time",
    o_orderpriority="text",
)
EVENT_HASH = hash_sql(
    event_id="text", ts="time", user_id="text", event_type="text", value="number", props="text"
)


@query(f"SELECT o_orderkey, {ORDER_HASH} AS record_hash FROM orders")
def record_hashes_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.lower(F.hex(record_hash(o, o.columns))).alias("record_hash"))


@query(f"""
  WITH gaps AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type,
                CASE WHEN value > 20 THEN value END AS value, props FROM events)
  SELECT event_id, {EVENT_HASH} AS record_hash FROM gaps
""")
def record_hashes_with_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.withColumns(
        {
            "event_type": F.when(F.col("event_type") != "view", F.col("event_type")),
            "value": F.when(F.col("value") > 20, F.col("value")),
        }
    )
    return e.select("event_id", F.lower(F.hex(record_hash(e, e.columns))).alias("record_hash"))


@query("""
  SELECT doc_id, sha256(CASE WHEN text IS NULL THEN 'N' ELSE
    'V' || length(LEFT(text, 100)) || ':' || LEFT(text, 100) END || 'V' || length(upper(lang)) || ':' || upper(lang))
    AS record_hash
  FROM documents
""")
def record_hashes_truncated(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hashed = record_hash(d, ["text", F.upper("lang")], truncate=100)
    return d.select("doc_id", F.lower(F.hex(hashed)).alias("record_hash"))


# --- lookups ---------------------------------------------------------------------------


@query("""
  SELECT o.o_orderkey, o.o_custkey, COALESCE(k.SURROGATE_KEY, -1) AS CUSTOMER_SK
  FROM orders o LEFT JOIN customer_keys k
    ON k.NATURAL_KEY_VALUE = CAST(o.o_custkey AS VARCHAR) AND k.NATURAL_KEY_DOMAIN = 'SALES'
""")
def foreign_key_by_key_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = fixture(spark, sf_dir, "customer_keys")
    return foreign_keys.resolve_foreign_keys(o, [KeyLookup("CUSTOMER_SK", ["o_custkey"], keys, "SALES")])


@query("""
  SELECT c.c_custkey, COALESCE(a.NATION_SK, -1) AS ANY_SK, COALESCE(b.NATION_SK, -1) AS CURRENT_SK
  FROM customer c
  LEFT JOIN (SELECT DISTINCT n_nationkey, NATION_SK FROM nation_history) a ON a.n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT DISTINCT n_nationkey, NATION_SK FROM nation_history WHERE IS_CURRENT = 'Y') b
    ON b.n_nationkey = c.c_nationkey
""")
def foreign_key_by_master(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    any_version = replace(_nation_fk(spark, sf_dir), sk_column="ANY_SK")
    current = replace(any_version, sk_column="CURRENT_SK", current_only=Scd2Config())
    return foreign_keys.resolve_foreign_keys(c, [any_version, current]).select("c_custkey", "ANY_SK", "CURRENT_SK")


@query("""
  SELECT o.o_orderkey, COALESCE(k1.SURROGATE_KEY, -1) AS ORDER_SK, COALESCE(k2.SURROGATE_KEY, -1) AS CUSTOMER_SK
  FROM orders o
  LEFT JOIN order_keys k1 ON k1.NATURAL_KEY_VALUE = CAST(o.o_orderkey AS VARCHAR) AND k1.NATURAL_KEY_DOMAIN = 'SALES'
  LEFT JOIN customer_keys k2 ON k2.NATURAL_KEY_VALUE = CAST(o.o_custkey AS VARCHAR) AND k2.NATURAL_KEY_DOMAIN = 'OTHER'
""")
def two_surrogate_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = foreign_keys.lookup_surrogate_key(
        o, ["o_orderkey"], fixture(spark, sf_dir, "order_keys"), "SALES", "ORDER_SK"
    )
    second = KeyLookup("CUSTOMER_SK", ["o_custkey"], fixture(spark, sf_dir, "customer_keys"), "OTHER")
    return foreign_keys.resolve_foreign_keys(own, [second]).select("o_orderkey", "ORDER_SK", "CUSTOMER_SK")


@query("""
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, COALESCE(m.sk, -1) AS CUSTOMER_SK
  FROM lineitem l
  LEFT JOIN (
    SELECT o.o_orderkey, k.SURROGATE_KEY AS sk
    FROM orders o JOIN customer_keys k
      ON k.NATURAL_KEY_VALUE = CAST(o.o_custkey AS VARCHAR) AND k.NATURAL_KEY_DOMAIN = 'SALES'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY o.o_orderkey ORDER BY k.SURROGATE_KEY) = 1
  ) m ON m.o_orderkey = l.l_orderkey
""")
def foreign_key_by_bridge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fk = BridgeLookup(
        "CUSTOMER_SK", "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"],
        fixture(spark, sf_dir, "customer_keys"), "SALES",
    )
    return foreign_keys.resolve_foreign_keys(lines, [fk])


# --- merge, statistics, scans ----------------------------------------------------------


@query(f"""
  SELECT COALESCE(v.CUSTOMER_KEY, -1) AS CUSTOMER_SK, v.c_custkey, v.c_name, v.c_mktsegment,
         {ts_sql('v.VALID_FROM', 'VALID_FROM')}, {ts_sql('v.VALID_TO', 'VALID_TO')}, v.IS_CURRENT,
         '{RUN_TS}.000000' AS CREATED_TIMESTAMP, '{RUN_TS}.000000' AS LAST_UPDATED_TIMESTAMP,
         CAST(7 AS BIGINT) AS ETL_JOB_RUN_ID
  FROM customer_view v
  LEFT JOIN (SELECT c_custkey, VALID_FROM FROM versions WHERE c_mktsegment <> 'MACHINERY' AND IS_CURRENT <> 'N') t
    ON v.c_custkey = t.c_custkey AND v.VALID_FROM = t.VALID_FROM
  WHERE t.c_custkey IS NULL
""")
def merge_from_business_view(spark, sf_dir):
    fixture(spark, sf_dir, "customer_view").createOrReplaceTempView("v_customer")
    view = scan_view(spark, "v_customer")
    target = fixture(spark, sf_dir, "versions").filter("c_mktsegment <> 'MACHINERY' AND IS_CURRENT <> 'N'")
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    return portable(merge.merge_from_view(view, target, "c_custkey", columns, "CUSTOMER_KEY", "CUSTOMER_SK", CTX))


def statistics_sql(current: str, closed: str) -> str:
    return f"""
      SELECT 'Current Records' AS metric_name, count(*) AS metric_value FROM versions WHERE IS_CURRENT = '{current}'
      UNION ALL SELECT 'Historical Records', count(*) FROM versions WHERE IS_CURRENT = '{closed}'
      UNION ALL SELECT 'Total Records', count(*) FROM versions
    """


@query(statistics_sql("Y", "N"))
def table_statistics(spark, sf_dir):
    return stats.table_statistics(fixture(spark, sf_dir, "versions"))


@query(statistics_sql("X", "Y"))
def table_statistics_other_flags(spark, sf_dir):
    cfg = Scd2Config(current_value="X", closed_value="Y")
    return stats.table_statistics(fixture(spark, sf_dir, "versions"), cfg)


@query("SELECT count(*) AS row_count FROM lineitem")
def table_row_count(spark, sf_dir):
    return stats.row_count(table(spark, sf_dir, "lineitem"))


@query("SELECT c_custkey FROM versions WHERE IS_CURRENT = 'N'")
def historical_version_rows(spark, sf_dir):
    return scd2.historical_rows(fixture(spark, sf_dir, "versions")).select("c_custkey")


@query("""
  SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS rebate, COALESCE(l_returnflag, 'U') AS flag
  FROM lineitem
""")
def projected_scan(spark, sf_dir):
    items = [
        "l_orderkey",
        {"name": "l_linenumber"},
        {"name": "rebate", "expression": "l_extendedprice * l_discount"},
        {"name": "flag", "expression": "COALESCE(l_returnflag, 'U')"},
    ]
    return select_columns(table(spark, sf_dir, "lineitem"), items)


# --- ingest ----------------------------------------------------------------------------

MAPPING = [
    ColumnMapping("order_no", "ORDER_ID", "BIGINT", nullable=False),
    ColumnMapping("customer_no", "CUSTOMER_ID", "BIGINT"),
    ColumnMapping("price", "PRICE", "DECIMAL(18,2)", nullable=False),
    ColumnMapping("ordered_at", "ORDERED_AT", "TIMESTAMP(6)"),
    ColumnMapping("prio", "PRIO", "VARCHAR(20)", convert_expression="LEFT(UPPER([{col}]), {len})", source_length=8),
]
FIXTURES["typed_extract"] = """
  SELECT CAST(order_no AS BIGINT) AS ORDER_ID, TRY_CAST(customer_no AS BIGINT) AS CUSTOMER_ID,
         TRY_CAST(price AS DECIMAL(18,2)) AS PRICE, TRY_CAST(ordered_at AS TIMESTAMP) AS ORDERED_AT,
         LEFT(UPPER(prio), 8) AS PRIO,
         concat_ws(',', CASE WHEN customer_no = 'n/a' THEN 'CUSTOMER_ID' END,
                   CASE WHEN price IS NULL THEN 'PRICE' END,
                   CASE WHEN ordered_at = 'not a date' THEN 'ORDERED_AT' END) AS failed
  FROM order_extract
"""


def _typed(spark, sf_dir) -> DataFrame:
    return ingest.typed(fixture(spark, sf_dir, "order_extract"), MAPPING)


@query(f"""
  SELECT ORDER_ID, CUSTOMER_ID, PRICE, {ts_sql('ORDERED_AT')}, PRIO, CAST(7 AS BIGINT) AS ETL_LOAD_ID,
         '{RUN_TS}.000000' AS ETL_LOAD_TIMESTAMP
  FROM typed_extract WHERE failed = ''
""")
def ingest_accepted(spark, sf_dir):
    return portable(ingest.with_load_audit(ingest.accepted(_typed(spark, sf_dir)), CTX))


@query("""
  SELECT failed AS failed_columns, CAST(ORDER_ID AS VARCHAR) AS order_no FROM typed_extract WHERE failed <> ''
""")
def ingest_rejected(spark, sf_dir):
    bad = ingest.rejected(_typed(spark, sf_dir))
    return bad.select("failed_columns", F.get_json_object("source_row", "$.order_no").alias("order_no"))


@query("""
  SELECT count(*) AS rows_read, count(*) FILTER (failed = '') AS rows_loaded,
         count(*) FILTER (failed <> '') AS rows_rejected
  FROM typed_extract
""")
def ingest_counts(spark, sf_dir):
    return ingest.load_counts(_typed(spark, sf_dir))


def _ingested(spark, sf_dir) -> str:
    """A load stored twice: the second time replaces the first."""
    target = folder(spark, "raw")
    for _ in range(2):
        ingest.ingest(fixture(spark, sf_dir, "order_extract"), MAPPING, target, CTX, audit=True)
    return target


@query(f"""
  SELECT ORDER_ID, CUSTOMER_ID, PRICE, {ts_sql('ORDERED_AT')}, PRIO, CAST(7 AS BIGINT) AS ETL_LOAD_ID,
         '{RUN_TS}.000000' AS ETL_LOAD_TIMESTAMP, 7 AS load_id
  FROM typed_extract WHERE failed = ''
""")
def ingest_written(spark, sf_dir):
    return portable(ingest.loaded_rows(spark, _ingested(spark, sf_dir)))


@query("""
  SELECT failed AS failed_columns, CAST(ORDER_ID AS VARCHAR) AS order_no, 7 AS load_id FROM typed_extract WHERE failed <> ''
""")
def ingest_rejects_written(spark, sf_dir):
    bad = ingest.rejected_rows(spark, _ingested(spark, sf_dir))
    return bad.select("failed_columns", F.get_json_object("source_row", "$.order_no").alias("order_no"), "load_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def staged_rows(spark, sf_dir):
    return stash(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))

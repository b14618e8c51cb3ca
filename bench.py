"""Times the headline operators and prints one JSON line.

``python bench.py`` times the library; ``python bench.py --compare`` also times the plain
form of each operator (what a line-by-line rendering of the statements would do) and prints
a table. Inputs: ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``$BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.config import KeyLookup, LoadSpec, RunContext
from sedimenta.functions.text import key_hash, natural_key, record_hash, timestamp
from sedimenta.operators import catalog, graph, ingest, merge, runlog, scd2, stats, surrogate
from sedimenta.plans.load import load_delta, load_history
from sedimenta.sources.bucketed import BucketedTable
from sedimenta.sources.versioned import VersionedTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CTX = RunContext("2024-02-01 00:00:00")
SPEC = LoadSpec(business_key=["o_orderkey"], sk_column="ORDER_SK", domain="SALES")
DELTA = LoadSpec(business_key=["o_orderkey"], surrogate=None)
EXTRACT = [
    ingest.ColumnMapping("o_orderkey", "ORDER_ID", "BIGINT", nullable=False),
    ingest.ColumnMapping("o_custkey", "CUSTOMER_ID", "BIGINT"),
    ingest.ColumnMapping("o_totalprice", "PRICE", "DECIMAL(18,2)"),
    ingest.ColumnMapping("o_orderdate", "ORDERED_AT", "TIMESTAMP(6)"),
    ingest.ColumnMapping("o_orderpriority", "PRIO", "VARCHAR(20)"),
]


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Inputs:
    """Tables and derived inputs; histories and key tables are stored once, outside the timing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.work = tempfile.mkdtemp(prefix="bench-")
        self.orders = self.table("orders")
        self.history = self.store("history", self._history(), "IS_CURRENT")
        self.order_keys = self.store("order_keys", self._keys("orders", "o_orderkey", "o_orderstatus <> 'P'"))
        self.customer_keys = self.store("customer_keys", self._keys("customer", "c_custkey", "c_acctbal >= 0"))
        parts = self.table("part").select(F.col("p_partkey").alias("k"), "p_type", "p_size", "p_brand")
        half, third = F.floor(F.col("k") / 2).cast("long"), F.floor(F.col("k") / 3).cast("long")
        steps = [parts.filter("k > 0").select(end.cast("string").alias("from_id"),
                 F.col("k").cast("string").alias("to_id"), F.lit(kind).alias("edge_type"), F.col("k").alias("job_id"))
                 for end, kind in ((half, "ETL"), (third, "VIEW"))]
        self.edges = self.store("edges", steps[0].unionByName(steps[1]))
        # One percent of the orders, neighbours by key, that change with every load.
        self.loads = 0
        current = self.history.drop("ORDER_SK", "CUSTOMER_SK")
        self.buckets = BucketedTable(f"{self.work}/buckets", current.schema, ["o_orderkey"], buckets=200, width=1000)
        self.whole = VersionedTable(f"{self.work}/whole", current.schema)
        is_open = F.col("IS_CURRENT") == "Y"
        self.buckets.adopt(current, is_open)
        self.whole.publish(current.withColumn("_closed_now", ~is_open))
        self.registered = self.store("registered", self._catalog(parts, "Brand#9", "Brand#0"))
        self.actual = self.store("actual", self._catalog(parts, "Brand#7", "Brand#3"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    def store(self, name: str, df: DataFrame, *partition: str) -> DataFrame:
        path = f"{self.work}/{name}"
        df.write.partitionBy(*partition).parquet(path)
        return self.spark.read.parquet(path)

    def _history(self) -> DataFrame:
        o = self.orders.filter("o_orderpriority <> '5-LOW'")
        o = o.withColumn(
            "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "?").otherwise(F.col("o_orderstatus"))
        )
        start = timestamp("2023-06-01 00:00:00")
        current = o.select(
            "*", F.lit(-1).cast("long").alias("ORDER_SK"), F.lit(-1).cast("long").alias("CUSTOMER_SK"),
            record_hash(o, o.columns).alias("RECORD_HASH"), start.alias("VALID_FROM"),
            timestamp("9999-12-31 23:59:59.999999").alias("VALID_TO"), start.alias("CREATED_TIMESTAMP"),
            start.alias("LAST_UPDATED_TIMESTAMP"), F.lit("init").alias("CREATED_BY"),
            F.lit("init").alias("LAST_UPDATED_BY"), F.lit("Y").alias("IS_CURRENT"),
        )
        closed = current.filter("o_orderstatus = 'F'").withColumns(
            {"IS_CURRENT": F.lit("N"), "VALID_FROM": timestamp("2023-01-01 00:00:00"), "VALID_TO": start}
        )
        return current.unionByName(closed)

    def _keys(self, table: str, column: str, where: str) -> DataFrame:
        t = self.table(table).filter(where)
        return t.select(
            F.col(column).alias("SURROGATE_KEY"), natural_key(t, [column]).alias("NATURAL_KEY_VALUE"),
            F.lit("SALES").alias("NATURAL_KEY_DOMAIN"),
        )

    def _catalog(self, parts: DataFrame, without: str, changed: str) -> DataFrame:
        kind = F.when(F.col("p_brand") == changed, F.concat(F.lit("X"), "p_type")).otherwise(F.col("p_type"))
        return parts.filter(F.col("p_brand") != without).select(
            F.col("k").alias("column_id"), F.col("p_size").cast("long").alias("table_id"),
            F.concat(F.lit("c_"), F.col("k").cast("string")).alias("column_name"),
            F.col("k").cast("int").alias("position"), kind.alias("column_type"), F.lit(10).alias("length"),
            F.lit("Y").alias("nullable"),
        )

    @property
    def spec(self) -> LoadSpec:
        fk = KeyLookup("CUSTOMER_SK", ["o_custkey"], self.customer_keys, "SALES")
        return LoadSpec(["o_orderkey"], sk_column="ORDER_SK", domain="SALES", foreign_keys=[fk])

    def delta(self) -> tuple[DataFrame, RunContext]:
        self.loads += 1
        near = self.orders.filter(F.col("o_orderkey") % 100_000 < 1000)
        changed = near.withColumn("o_orderstatus", F.lit(f"V{self.loads}"))
        return changed, RunContext(f"2024-02-{self.loads:02d} 00:00:00", run_id=self.loads)

    @property
    def job_runs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("run_id"), F.col("user_id").alias("job_id"), F.col("ts").alias("start_time"),
            F.col("event_type").alias("status"), F.col("value").alias("duration_seconds"),
        )


# --- built forms -----------------------------------------------------------------------


def keys_orders(i: Inputs):
    sink(surrogate.generate_surrogate_keys(i.orders, i.order_keys, ["o_orderkey"], "SALES", CTX))


def keys_lineitem(i: Inputs):
    empty = surrogate.ensure_key_table(i.spark, CTX, seed=False)
    lines = i.table("lineitem")
    sink(surrogate.generate_surrogate_keys(lines, empty, ["l_orderkey", "l_linenumber"], "SALES", CTX))


def classify_orders(i: Inputs):
    sink(scd2.classify(i.orders, i.history, SPEC))


def apply_orders(i: Inputs):
    sink(scd2.apply(i.history, i.orders, i.spec, CTX, i.order_keys).rows)


def statistics_history(i: Inputs):
    sink(stats.table_statistics(i.history))


def merge_view(i: Inputs):
    view = i.history.withColumn("VIEW_SK", F.col("ORDER_SK"))
    target = i.history.filter("o_orderpriority <> '2-HIGH'")
    sink(merge.merge_from_view(view, target, "o_orderkey", ["o_custkey"], "VIEW_SK", "SK", CTX))


def latest_run(i: Inputs):
    sink(runlog.latest_run(i.job_runs, columns=["status", "duration_seconds"]))


def drift(i: Inputs):
    sink(catalog.drift_summary(catalog.compare_catalogs(i.registered, i.actual)))


def delta_publish(i: Inputs):
    batch, ctx = i.delta()
    load_delta(i.spark, batch, i.buckets, DELTA, ctx)


def ingest_load(i: Inputs):
    text = i.orders.select(*[F.col(c).cast("string").alias(c) for c in i.orders.columns])
    ingest.ingest(text, EXTRACT, f"{i.work}/raw", RunContext("2024-02-01 00:00:00", run_id=1))


def reach(i: Inputs):
    top = i.edges.agg(F.max(F.col("job_id")).alias("m")).select(F.col("m").cast("string").alias("root_id"))
    sink(graph.reachable(i.edges, top))


# --- plain forms -----------------------------------------------------------------------


def _plain_keys(source: DataFrame, columns: list[str], keys: DataFrame):
    known = keys.filter("NATURAL_KEY_DOMAIN = 'SALES'").select(F.col("NATURAL_KEY_VALUE").alias("natural_key"))
    top = keys.agg(F.coalesce(F.max("SURROGATE_KEY"), F.lit(0))).first()[0]
    fresh = source.select(natural_key(source, columns).alias("natural_key")).distinct()
    fresh = fresh.join(known, "natural_key", "left_anti")
    numbered = fresh.withColumn("sk", F.lit(top) + F.dense_rank().over(Window.orderBy("natural_key")))
    sink(numbered.withColumn("h", key_hash(F.col("natural_key"))))


def plain_keys_orders(i: Inputs):
    _plain_keys(i.orders, ["o_orderkey"], i.order_keys)


def plain_keys_lineitem(i: Inputs):
    empty = surrogate.ensure_key_table(i.spark, CTX, seed=False)
    _plain_keys(i.table("lineitem"), ["l_orderkey", "l_linenumber"], empty)


def _plain_new(i: Inputs):
    current = i.history.filter("IS_CURRENT = 'Y'").select("o_orderkey", F.lit(1).alias("_hit"))
    return i.orders.join(current, "o_orderkey", "left").filter("_hit IS NULL").drop("_hit")


def _plain_changed(i: Inputs):
    current = i.history.filter("IS_CURRENT = 'Y'").select("o_orderkey", F.col("RECORD_HASH").alias("_old"))
    hashed = i.orders.withColumn("RECORD_HASH", record_hash(i.orders, i.orders.columns))
    return hashed.join(current, "o_orderkey").filter("RECORD_HASH <> _old").drop("_old")


def plain_classify_orders(i: Inputs):
    sink(_plain_new(i))
    sink(_plain_changed(i))


def plain_apply_orders(i: Inputs):
    new = i.spark.read.parquet(_saved(i, "new", _plain_new(i)))
    new = new.withColumn("RECORD_HASH", record_hash(new, i.orders.columns))
    changed = i.spark.read.parquet(_saved(i, "changed", _plain_changed(i)))
    for rows in (new, changed):
        sink(scd2.new_versions(rows, i.spec, CTX, i.order_keys))
    sink(scd2.close_versions(i.history, changed, SPEC, CTX))


def _saved(i: Inputs, name: str, df: DataFrame) -> str:
    path = tempfile.mkdtemp(dir=i.work) + f"/{name}"
    df.write.parquet(path)
    return path


def plain_statistics_history(i: Inputs):
    for flag in ("IS_CURRENT = 'Y'", "IS_CURRENT = 'N'", "TRUE"):
        sink(i.history.filter(flag).agg(F.count("*")))


def plain_merge_view(i: Inputs):
    target = i.history.filter("o_orderpriority <> '2-HIGH'").select("o_orderkey", "VALID_FROM", F.lit(1).alias("_hit"))
    sink(i.history.join(target, ["o_orderkey", "VALID_FROM"], "left").filter("_hit IS NULL"))


def plain_latest_run(i: Inputs):
    newest = Window.partitionBy("job_id").orderBy(F.desc("start_time"), F.desc("run_id"))
    sink(i.job_runs.withColumn("rn", F.row_number().over(newest)).filter("rn = 1"))


def plain_drift(i: Inputs):
    for row in i.registered.select("table_id").distinct().collect():
        one = F.col("table_id") == row["table_id"]
        sink(catalog.drift_summary(catalog.compare_catalogs(i.registered.filter(one), i.actual.filter(one))))


def plain_delta_publish(i: Inputs):
    batch, ctx = i.delta()
    load_history(i.spark, batch, i.whole, DELTA, ctx)


def plain_ingest_load(i: Inputs):
    text = i.orders.select(*[F.col(c).cast("string").alias(c) for c in i.orders.columns])
    rows = i.spark.read.parquet(_saved(i, "typed", ingest.typed(text, EXTRACT)))
    ingest.accepted(rows).write.parquet(tempfile.mkdtemp(dir=i.work) + "/good")
    ingest.load_counts(rows).first()
    ingest.rejected(rows).write.parquet(tempfile.mkdtemp(dir=i.work) + "/bad")


def plain_reach(i: Inputs):
    root = str(i.edges.agg(F.max(F.col("job_id"))).first()[0])
    queue, seen = [(root, 0)], {root}
    while queue:
        node, depth = queue.pop(0)
        for r in i.edges.filter(F.col("to_id") == node).select("from_id").collect():
            if r[0] not in seen:
                seen.add(r[0])
                queue.append((r[0], depth + 1))


PAIRS = {
    "surrogate_keys_orders": (keys_orders, plain_keys_orders),
    "surrogate_keys_lineitem": (keys_lineitem, plain_keys_lineitem),
    "scd2_classify_orders": (classify_orders, plain_classify_orders),
    "scd2_apply_orders": (apply_orders, plain_apply_orders),
    "table_statistics": (statistics_history, plain_statistics_history),
    "view_merge": (merge_view, plain_merge_view),
    "latest_run_per_job": (latest_run, plain_latest_run),
    "schema_drift": (drift, plain_drift),
    "lineage_reachability": (reach, plain_reach),
    "delta_publish": (delta_publish, plain_delta_publish),
    "ingest_load": (ingest_load, plain_ingest_load),
}


def median_times(forms, inputs: Inputs, runs: int) -> list[float]:
    """Median of each form after one warm-up; the forms take turns."""
    times = [[] for _ in forms]
    for n in range(runs + 1):
        for fn, seen in zip(forms, times):
            start = time.perf_counter()
            fn(inputs)
            if n:
                seen.append(time.perf_counter() - start)
    return [round(statistics.median(t), 3) for t in times]


def main() -> None:
    inputs = Inputs(session())
    wanted = [a for a in sys.argv[1:] if not a.startswith("-")] or list(PAIRS)
    compare = "--compare" in sys.argv
    built = {}
    for name in wanted:
        times = median_times(PAIRS[name] if compare else PAIRS[name][:1], inputs, RUNS)
        built[name] = times[0]
        if compare:
            print(f"| {name} | {times[1]:.2f} | {times[0]:.2f} |", flush=True)
    scale = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(built.values()), 3), "unit": "sec",
                      "queries": built, "sf": float(scale)}))


if __name__ == "__main__":
    main()

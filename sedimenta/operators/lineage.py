"""Lineage edges from jobs and view texts, and column mappings of views.

``views`` has view_id, db_name, view_name and ddl; ``objects`` has table_id, db_name and
table_name. Node ids in edges are texts: a table id, or ``EXT::db.name`` for an object the
catalogue does not know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import RunContext
from sedimenta.functions import viewtext
from sedimenta.functions.text import timestamp
from sedimenta.operators.keyed_join import one_per_key
from sedimenta.sources.workspace import stash

EXTERNAL = "EXT::"


def etl_edges(jobs: DataFrame) -> DataFrame:
    """One edge per job that has both a source and a target table."""
    return jobs.filter(F.col("source_table_id").isNotNull() & F.col("target_table_id").isNotNull()).select(
        F.col("source_table_id").cast("string").alias("from_id"),
        F.col("target_table_id").cast("string").alias("to_id"),
        F.lit("ETL").alias("edge_type"),
        "job_id",
        "job_name",
    )


def view_sources(views: DataFrame, carry: Sequence[str] = (), keep_empty: bool = False) -> DataFrame:
    """Distinct source objects per view, upper-cased; ``source_db`` is null where not given.

    ``carry`` names view columns to keep; with ``keep_empty`` a view without sources has one
    row with empty source columns.
    """
    sources = viewtext.source_objects(F.col("ddl"), F.col("db_name"), F.col("view_name"))
    unfold = F.explode_outer if keep_empty else F.explode
    return views.select("view_id", *carry, unfold(sources).alias("s")).select(
        "view_id", *carry, F.col("s.db").alias("source_db"), F.col("s.name").alias("source_name")
    )


def unread_views(views: DataFrame) -> DataFrame:
    """``view_id`` of views whose sources may be incomplete: their texts have forms that are not read."""
    return views.filter(viewtext.may_miss_sources(F.col("ddl"))).select("view_id")


def resolve_objects(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``source_id``: the table a name stands for, null if there is none.

    A name without a database that several tables share takes the smallest id.
    """
    upper = objects.select(F.upper("db_name").alias("_db"), F.upper("table_name").alias("source_name"), "table_id")
    anywhere = upper.withColumn("_db", F.lit(""))
    keys = ["_db", "source_name"]
    named = upper.filter(F.col("_db").isNotNull()).unionByName(anywhere)
    known = one_per_key(named, keys, F.min("table_id").alias("source_id"))
    keyed = sources.withColumn("_db", F.coalesce("source_db", F.lit("")))
    return keyed.join(known, keys, "left").select(*sources.columns, "source_id")


def view_edges(resolved: DataFrame) -> DataFrame:
    """Edges from the sources of a view to the view; an edge to itself is left out."""
    external = F.concat(F.lit(EXTERNAL), F.coalesce("source_db", F.lit("")), F.lit("."), F.col("source_name"))
    return (
        resolved.filter(~F.col("source_id").eqNullSafe(F.col("view_id")))
        .select(
            F.coalesce(F.col("source_id").cast("string"), external).alias("from_id"),
            F.col("view_id").cast("string").alias("to_id"),
            F.lit("VIEW").alias("edge_type"),
            F.lit(None).cast("long").alias("job_id"),
            F.lit(None).cast("string").alias("job_name"),
        )
        .distinct()
    )


def all_edges(jobs: DataFrame, view_edge_rows: DataFrame) -> DataFrame:
    """ETL and view edges, one per (from, to, type, job)."""
    return (
        etl_edges(jobs)
        .unionByName(view_edge_rows)
        .groupBy("from_id", "to_id", "edge_type", "job_id")
        .agg(F.min("job_name").alias("job_name"))
    )


def consumers(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """Objects that read a node, or all (node, consumer) pairs."""
    reverse = edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("consumer_id"), "edge_type")
    if node_id is not None:
        reverse = reverse.filter(F.col("node_id") == node_id)
    return reverse.distinct()


# --- incremental parsing ---------------------------------------------------------------


def ddl_hash(ddl: Column) -> Column:
    return F.sha2(ddl, 256)


def views_to_parse(views: DataFrame, stored: DataFrame) -> DataFrame:
    """Views without stored rows for the hash of their present text."""
    seen = stored.select("view_id", "ddl_hash").distinct()
    return views.withColumn("ddl_hash", ddl_hash(F.col("ddl"))).join(seen, ["view_id", "ddl_hash"], "left_anti")


def refresh_view_lineage(views: DataFrame, stored: DataFrame, objects: DataFrame, ctx: RunContext) -> DataFrame:
    """Stored source rows with those of new and changed views parsed anew.

    Unchanged views keep their rows. A parsed view without sources gets one row with empty
    source columns, so that it counts as parsed. Views that are gone keep their rows.
    """
    pending = stash(views_to_parse(views, stored), "pending-views")
    found = resolve_objects(view_sources(pending, ["ddl_hash"], keep_empty=True), objects)
    parsed = found.select(
        "view_id", "source_id", "source_db", "source_name", "ddl_hash",
        timestamp(ctx.run_ts).alias("parsed_at"),
    )
    kept = stored.join(pending.select("view_id"), "view_id", "left_anti")
    return kept.select(*parsed.columns).unionByName(parsed)


def stored_edges(lineage: DataFrame) -> DataFrame:
    """View edges from stored source rows; marker rows carry none."""
    return view_edges(lineage.filter(F.col("source_name").isNotNull()))


# --- column mappings: ``items`` has view_id, position, expression and target_column ------


def _with_refs(items: DataFrame) -> DataFrame:
    return items.withColumn("_refs", viewtext.column_refs(F.col("expression")))


def view_columns(views: DataFrame, items: DataFrame) -> DataFrame:
    """Columns of each view: target, kind of transformation, expression, source columns.

    ``items`` are the views' select items; the texts in ``views`` tell what an alias stands for.

    Kinds, tested in this order: ALL_COLUMNS, DIRECT, CASE, CAST, COMPUTED. An alias stands
    for its table; a column without alias belongs to the table if there is only one.
    """
    # Reading a text costs far more than moving it, and a few splits hold very many texts.
    spread = views.select("view_id", "ddl").repartition("view_id", "ddl")
    tables = spread.select("view_id", viewtext.table_items(F.col("ddl")).alias("_tables"))
    items = _with_refs(items).join(tables, "view_id")
    upper = F.upper("expression")
    simple = viewtext.is_column(F.col("expression"))
    kind = (
        F.when(F.col("expression") == "*", "ALL_COLUMNS")
        .when(simple, "DIRECT")
        .when(F.contains(upper, F.lit("CASE")) & F.contains(upper, F.lit("WHEN")), "CASE")
        .when(F.contains(upper, F.lit("CAST")) | F.contains(upper, F.lit("CONVERT")), "CAST")
        .otherwise("COMPUTED")
    )

    def full(t: Column) -> Column:
        return F.concat_ws(".", t["db"], t["name"])

    names = F.array_distinct(F.transform("_tables", full))
    sole = F.when(F.size(names) == 1, F.element_at(names, 1))

    def owner(alias: Column) -> Column:
        hits = F.filter(
            "_tables", lambda t: (F.upper(t["alias"]) == F.upper(alias)) | (F.upper(t["name"]) == F.upper(alias))
        )
        last = F.try_element_at(hits, F.lit(-1))
        return F.when(alias.isNull(), sole).when(last.isNotNull(), full(last))

    sources = F.transform("_refs", lambda r: F.struct(owner(r["alias"]).alias("table"), r["column"].alias("column")))
    return items.select(
        "view_id", "position", "target_column", kind.alias("transform_type"), "expression",
        F.when(F.col("expression") == "*", F.array().cast(_PAIRS))
        .otherwise(F.array_distinct(sources)).alias("sources"),
    )


_PAIRS = "array<struct<table:string,column:string>>"


def statement_columns(items: DataFrame) -> DataFrame:
    """Columns of SELECT statements, by their select items, with the coarser kinds.

    Columns count as sources only with an alias; an alias that contains "constant" marks
    constant columns.
    """
    items = _with_refs(items)
    upper = F.upper("expression")
    kind = (
        F.when(F.contains(upper, F.lit("CASE")) & F.contains(upper, F.lit("WHEN")), "CONDITIONAL_LOGIC")
        .when(F.contains(upper, F.lit("CAST")) | F.contains(upper, F.lit("CONVERT")), "TYPE_CONVERSION")
        .otherwise("DIRECT_MAPPING")
    )

    def named(constant: bool) -> Column:
        def wanted(r: Column) -> Column:
            is_constant = F.contains(F.lower(r["alias"]), F.lit("constant"))
            return F.coalesce(is_constant if constant else ~is_constant, F.lit(False))

        return F.array_sort(F.array_distinct(F.transform(F.filter("_refs", wanted), lambda r: r["column"])))

    return items.select(
        "view_id", "position", "target_column", kind.alias("transform_type"), "expression",
        named(False).alias("source_columns"), named(True).alias("constant_columns"),
    )

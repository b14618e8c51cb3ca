"""Catalogue of layers, databases, tables and columns: counts, search, drift and sync.

A column catalogue has the columns of ``CATALOG_SCHEMA``. Comparisons run over the whole
catalogue at once; a table's columns are matched by upper-cased name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.types import DEFAULT_TYPE, MAX_LENGTH
from sedimenta.operators.keyed_join import one_per_key
from sedimenta.operators.substring import matching_pairs
from sedimenta.operators.surrogate import number_distinct
from sedimenta.sources.workspace import stash

DELETED_MARK = " [DELETED]"
# Compared properties and the word used for each in a message.
FACETS = {"column_type": "type", "length": "length", "nullable": "nullable", "position": "position"}
DRIFT_FACETS = ("column_type", "length", "nullable", "position")


class Drift:
    ONLY_REGISTERED = "ONLY_REGISTERED"
    ONLY_ACTUAL = "ONLY_ACTUAL"
    MISMATCH = "MISMATCH"
    SAME = "SAME"


# --- counts and search -----------------------------------------------------------------


def database_counts(layers: DataFrame, databases: DataFrame) -> DataFrame:
    """Layers with their number of databases."""
    per_layer = databases.groupBy("layer_id").agg(F.count("database_id").alias("database_count"))
    counted = layers.join(per_layer, "layer_id", "left")
    return counted.fillna(0, ["database_count"])


def table_counts(
    databases: DataFrame, layers: DataFrame, tables: DataFrame, layer_id: int | None = None
) -> DataFrame:
    """Databases of known layers with their number of tables."""
    if layer_id is not None:
        databases = databases.filter(F.col("layer_id") == layer_id)
    per_database = tables.groupBy("database_id").agg(F.count("table_id").alias("table_count"))
    named = layers.select("layer_id", "layer_name", "layer_sequence")
    return (
        databases.join(named, "layer_id")
        .join(per_database, "database_id", "left")
        .fillna(0, ["table_count"])
    )


def column_counts(tables: DataFrame, columns: DataFrame, database_id: int | None = None) -> DataFrame:
    """Tables with their number of columns."""
    if database_id is not None:
        tables = tables.filter(F.col("database_id") == database_id)
    per_table = columns.groupBy("table_id").agg(F.count("column_id").alias("column_count"))
    return tables.join(per_table, "table_id", "left").fillna(0, ["column_count"])


def search_tables(
    tables: DataFrame,
    databases: DataFrame,
    search: str | None = None,
    layer_id: int | None = None,
    database_name: str | None = None,
) -> DataFrame:
    """Tables whose name or comment contains a text, without case; ``%`` and ``_`` are wildcards."""
    if layer_id is not None:
        tables = tables.filter(F.col("layer_id") == layer_id)
    if database_name:
        databases = databases.filter(F.col("database_name") == database_name)
    if search:
        pattern = f"%{search.upper()}%"
        tables = tables.filter(
            F.upper("table_name").like(pattern) | F.upper("comment_string").like(pattern)
        )
    named = databases.select("database_id", "database_name")
    return tables.join(named, "database_id")


def search_many(tables: DataFrame, databases: DataFrame, searches: DataFrame) -> DataFrame:
    """As :func:`search_tables` for every text of ``searches`` (column ``search``) at once.

    Rows are those of the tables with ``database_name`` and the ``search`` they match.
    """
    both = F.explode(F.array(F.upper("table_name"), F.upper("comment_string"))).alias("text")
    texts = tables.select(F.col("table_id").alias("id"), both)
    wanted = searches.select("search", F.upper("search").alias("pattern")).distinct()
    pairs = matching_pairs(texts, wanted).distinct()
    found = wanted.join(pairs, "pattern").select("search", F.col("id").alias("table_id"))
    named = databases.select("database_id", "database_name")
    # Tables from a small file are many rows all the same; they don't go to all tasks.
    return tables.join(found.hint("merge"), "table_id").join(named, "database_id")


def candidates(dictionary: DataFrame, tables: DataFrame, databases: DataFrame) -> DataFrame:
    """Tables and views of the database dictionary, flagged by whether they are registered."""
    known = (
        tables.join(databases.select("database_id", "database_name"), "database_id")
        .select(F.col("database_name").alias("db_name"), "table_name")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    return (
        dictionary.filter(F.col("table_kind").isin("T", "V"))
        .join(known, ["db_name", "table_name"], "left")
        .select(
            "db_name", "table_name", "table_kind",
            F.coalesce("comment_string", F.lit("")).alias("comment_string"),
            F.when(F.col("_known"), "Y").otherwise("N").alias("in_meta"),
        )
    )


# --- foreign types ---------------------------------------------------------------------


def map_source_types(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Target types for foreign columns, by a rule table.

    ``columns`` has ``source_datatype, max_length, precision, scale``; ``rules`` has
    ``rule_id, source_datatype, is_active, target_datatype, multiplier, target_max_length,
    target_precision, target_scale, type_format, convert_template``. The active rule with
    the smallest id wins; without one the type is ``VARCHAR(255)``. Adds ``target_type``,
    ``multiplier`` and ``convert_template``.
    """
    fields = [
        "rule_id", "target_datatype", "multiplier", "target_max_length",
        "target_precision", "target_scale", "type_format", "convert_template",
    ]
    active = rules.filter(F.col("is_active") == "Y").withColumn("_type", F.lower("source_datatype"))
    first = one_per_key(active, ["_type"], F.min(F.struct(*fields)).alias("_rule"))
    joined = columns.withColumn("_type", F.lower("source_datatype")).join(first, "_type", "left")

    rule = {name: F.col(f"_rule.{name}") for name in fields}

    def positive(c: Column) -> Column:
        return F.when(c != 0, c)

    multiplier = F.coalesce(positive(rule["multiplier"]), F.lit(1))
    scaled = F.least(
        F.col("max_length").cast("long") * multiplier,
        F.coalesce(positive(rule["target_max_length"]), F.lit(MAX_LENGTH)),
        F.lit(MAX_LENGTH),
    )
    length = F.when(F.col("max_length") > 0, scaled).otherwise(
        F.coalesce(rule["target_max_length"].cast("long"), F.lit(0))
    )
    precision = F.coalesce(
        positive(F.col("precision")),
        positive(rule["target_precision"]),
        positive(rule["target_max_length"]),
        F.lit(6),
    )
    scale = F.coalesce(F.col("scale"), rule["target_scale"], F.lit(0))

    rendered = rule["type_format"]
    for mark, value in (
        ("{base}", rule["target_datatype"]),
        ("{length}", length.cast("string")),
        ("{precision}", precision.cast("string")),
        ("{scale}", scale.cast("string")),
    ):
        rendered = F.replace(rendered, F.lit(mark), F.coalesce(value, F.lit("")))
    return joined.select(
        *columns.columns,
        F.coalesce(rendered, F.lit(DEFAULT_TYPE)).alias("target_type"),
        F.when(F.col("_rule").isNull(), F.lit(1)).otherwise(multiplier).cast("int").alias("multiplier"),
        rule["convert_template"].alias("convert_template"),
    )


# --- drift -----------------------------------------------------------------------------


def _side(columns: DataFrame, side: str) -> DataFrame:
    names = ["column_id", "column_name", "position", "column_type", "length", "nullable"]
    values = [F.rtrim(c) if c in ("column_type", "nullable") else F.col(c) for c in names]
    return columns.select(
        "table_id",
        F.upper("column_name").alias("_name"),
        F.struct(*[v.alias(c) for v, c in zip(values, names)]).alias(side),
    )


def table_digests(columns: DataFrame, facets: Sequence[str]) -> DataFrame:
    """One row per table with a digest of its columns that doesn't depend on their order.

    The digest holds the number of columns, and sum and exclusive or of two hashes over their
    names and properties; ``names`` counts different names. Aggregated on the map side.
    """
    side = _side(columns, "c")
    values = [F.col(f"c.{f}").cast("string") for f in facets]
    parts = [F.col("_name").isNull(), F.col("_name"), *[x for v in values for x in (v.isNull(), v)]]
    first, second = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
    return side.groupBy("table_id").agg(
        F.struct(
            F.count("*"), F.sum(first.bitwiseAND(0xFFFFFFFF)), F.sum(second.bitwiseAND(0xFFFFFFFF)),
            F.bit_xor(first), F.bit_xor(second),
        ).alias("digest"),
        F.size(F.collect_set(F.when(F.col("_name").isNotNull(), F.xxhash64("_name")))).alias("names"),
        F.count("*").alias("columns"),
    )


def _equal_tables(registered: DataFrame, actual: DataFrame, facets: Sequence[str]) -> DataFrame:
    """``table_id`` of tables that are the same on both sides, each column once."""
    left = table_digests(registered, facets).where(F.col("names") == F.col("columns"))
    right = table_digests(actual, facets).select("table_id", F.col("digest").alias("_digest"))
    return left.join(right, "table_id").where(F.col("digest") == F.col("_digest")).select("table_id")


def _paired(registered: DataFrame, actual: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Columns of both sides by table and name, ``r`` and ``a``.

    Two levels: tables with equal digests pair with themselves; only the columns of the others
    (and of tables with a missing id, which equals nothing) are shuffled and joined.
    """
    if "column_id" not in actual.columns:
        actual = actual.withColumn("column_id", F.lit(None).cast("long"))
    equal = stash(_equal_tables(registered, actual, facets), "equal-tables")
    r, a = _side(registered, "r"), _side(actual, "a")
    differing = [side.join(equal, "table_id", "left_anti") for side in (r, a)]
    met = differing[0].join(differing[1], ["table_id", "_name"], "full_outer")
    same = r.join(equal, "table_id", "left_semi").withColumn("a", F.col("r").cast(a.schema["a"].dataType))
    return met.unionByName(same)


def _differs(facet: str) -> Column:
    return ~F.col(f"r.{facet}").eqNullSafe(F.col(f"a.{facet}"))


def _status(facets: Sequence[str]) -> Column:
    changed = F.lit(False)
    for f in facets:
        changed = changed | _differs(f)
    return (
        F.when(F.col("a").isNull(), Drift.ONLY_REGISTERED)
        .when(F.col("r").isNull(), Drift.ONLY_ACTUAL)
        .when(changed, Drift.MISMATCH)
        .otherwise(Drift.SAME)
    )


def compare_catalogs(
    registered: DataFrame, actual: DataFrame, facets: Sequence[str] = DRIFT_FACETS
) -> DataFrame:
    """Every column of either side with its status and the list of differing properties."""

    def text(side: str, facet: str) -> Column:
        return F.coalesce(F.col(f"{side}.{facet}").cast("string"), F.lit("null"))

    messages = [
        F.when(
            _differs(f), F.concat(F.lit(f"{FACETS[f]}: "), text("r", f), F.lit(" -> "), text("a", f))
        )
        for f in facets
    ]
    both = F.col("r").isNotNull() & F.col("a").isNotNull()
    return _paired(registered, actual, facets).select(
        "table_id",
        F.coalesce("r.column_name", "a.column_name").alias("column_name"),
        _status(facets).alias("status"),
        F.when(both, F.array_join(F.array_compact(F.array(*messages)), "; ")).otherwise("").alias("message"),
    )


def drift_summary(compared: DataFrame) -> DataFrame:
    """Added, removed, changed and unchanged columns per table."""
    status = F.col("status")
    return compared.groupBy("table_id").agg(
        F.count_if(status != Drift.ONLY_REGISTERED).alias("total_actual"),
        F.count_if(status != Drift.ONLY_ACTUAL).alias("total_registered"),
        F.count_if(status == Drift.ONLY_ACTUAL).alias("added_count"),
        F.count_if(status == Drift.ONLY_REGISTERED).alias("removed_count"),
        F.count_if(status == Drift.MISMATCH).alias("changed_count"),
        F.count_if(status == Drift.SAME).alias("unchanged_count"),
    )


# --- sync ------------------------------------------------------------------------------


@dataclass(frozen=True)
class SyncMode:
    """What a sync does: which properties it compares and takes over, what it does to columns
    found on one side only. ``delete`` is ``"soft"`` (mark the type), ``"hard"`` or ``None``."""

    facets: Sequence[str] = ("column_type", "length", "nullable")
    insert: bool = True
    delete: str | None = "soft"


SOFT = SyncMode()
HARD = SyncMode(facets=("column_type", "length", "position"), delete="hard")
UPDATE_ONLY = SyncMode(insert=False, delete=None)


def sync_catalog(registered: DataFrame, actual: DataFrame, mode: SyncMode = SOFT) -> DataFrame:
    """The registered catalogue brought in line with the actual one, plus ``sync_action``.

    ``sync_action`` is INSERTED, UPDATED, DELETED or KEPT; rows removed by a hard delete are
    gone. New columns get ids after the largest one, in order of table, position and name.
    """
    top = registered.agg(F.coalesce(F.max("column_id"), F.lit(0))).first()[0]
    paired = _paired(registered, actual, mode.facets).withColumn("_status", _status(mode.facets))
    status = F.col("_status")

    def value(name: str) -> Column:
        if name not in mode.facets:
            return F.col(f"r.{name}")
        return F.when(status == Drift.MISMATCH, F.col(f"a.{name}")).otherwise(F.col(f"r.{name}"))

    gone = status == Drift.ONLY_REGISTERED
    marked = F.lit(False)
    kind = value("column_type")
    if mode.delete == "soft":
        marked = gone & ~F.contains(F.col("r.column_type"), F.lit(DELETED_MARK.strip()))
        marked = F.coalesce(marked, F.lit(False))
        kind = F.when(marked, F.concat("r.column_type", F.lit(DELETED_MARK))).otherwise(kind)
    stays = status != Drift.ONLY_ACTUAL
    if mode.delete == "hard":
        stays = stays & ~gone
    action = F.when(status == Drift.MISMATCH, "UPDATED").when(marked, "DELETED").otherwise("KEPT")
    synced = paired.filter(stays).select(
        F.col("r.column_id").alias("column_id"), "table_id", F.col("r.column_name").alias("column_name"),
        value("position").alias("position"), kind.alias("column_type"), value("length").alias("length"),
        value("nullable").alias("nullable"), action.alias("sync_action"),
    )
    if not mode.insert:
        return synced
    fresh = paired.filter(status == Drift.ONLY_ACTUAL).select(
        "table_id", F.col("a.position").alias("position"), F.col("a.column_name").alias("column_name"),
        F.col("a.column_type").alias("column_type"), F.col("a.length").alias("length"),
        F.col("a.nullable").alias("nullable"),
    )
    numbered = number_distinct(fresh, "table_id", "position", "column_name", position="_position")
    inserted = numbered.select(
        (F.lit(top) + F.col("_position")).alias("column_id"), "table_id", "column_name", "position",
        "column_type", "length", "nullable", F.lit("INSERTED").alias("sync_action"),
    )
    return synced.unionByName(inserted)

"""Reachability and levels in lineage graphs, by rounds of joins.

Every round works on all roots and nodes at once and writes its result to the shared folder,
so plans stay short and a lost executor costs at most one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators.keyed_join import one_per_key, only_keys_of
from sedimenta.operators.lineage import EXTERNAL
from sedimenta.operators.surrogate import number_distinct
from sedimenta.sources.workspace import folder, stash, write_counted

# Steps by which roots are ordered, so that those with common nodes share blocks.
NEIGHBOUR_STEPS = 4
# From this many times a round's own rows on, the rows reached before are filtered before they are shuffled.
MANY = 8
# Roots of a block that reach a node in one step of a round, in two, or before it.
KINDS = ("one", "two", "seen")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _neighbours(edges: DataFrame, direction: str) -> DataFrame:
    up = edges.select(F.col("to_id").alias("node_id"), F.col("from_id").alias("next_id"))
    down = edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("next_id"))
    if direction == "upstream":
        return up
    if direction == "downstream":
        return down
    if direction == "both":
        return up.unionByName(down)
    raise ValueError(f"unknown direction {direction!r}")


def _places(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct roots with a place of their own: root_id, block, bit (0 to 63).

    Roots that lead to the same nodes come to the same blocks: they are ordered by the ends of
    the paths of ``NEIGHBOUR_STEPS`` steps and less that go to the smallest node each time.
    """
    first = one_per_key(steps, ["node_id"], F.min("next_id").alias("_next")).withColumnRenamed("node_id", "_at")
    placed, ends = roots.select("root_id").distinct().withColumn("_end0", F.col("root_id")), ["_end0"]
    for k in range(NEIGHBOUR_STEPS):
        placed = placed.join(first, F.col(ends[0]) == F.col("_at"), "left")
        ends.insert(0, f"_end{k + 1}")
        placed = placed.select("root_id", *ends[1:], F.coalesce("_next", ends[1]).alias(ends[0]))
    ordered = stash(placed, "ends").repartitionByRange(*ends).sortWithinPartitions(*ends)
    numbered = ordered.select("root_id", F.monotonically_increasing_id().alias("_number"))
    number = F.col("_number")
    block, bit = F.shiftright(number, 6).alias("block"), number.bitwiseAND(63).cast("int").alias("bit")
    return stash(numbered.select("root_id", block, bit), "places")


def reachable(
    edges: DataFrame, roots: DataFrame, depth: int | None = None, direction: str = "upstream"
) -> DataFrame:
    """Nodes within ``depth`` steps of each root, or at any distance: root_id, node_id, distance.

    ``roots`` has one column ``root_id``. Cycles end by themselves because a node is visited
    once per root. External objects are reached but not followed.

    Roots go through the rounds in blocks of 64, as bits: a row says which roots of a block
    reach a node, so what roots have in common is joined and shuffled once for all of them.
    Only the result has a row per root and node.

    A round goes two steps from the nodes found last. Once far more was reached before than a
    round finds, only rows of it that may equal a node of the round are shuffled
    (:func:`only_keys_of`), so a round's shuffle grows with its own nodes.
    """
    spark = edges.sparkSession
    steps = stash(_neighbours(edges, direction).distinct(), "steps")
    places = _places(roots, steps)
    base = folder(spark, "reached")
    key = ["node_id", "block"]
    rounds = spark.read.schema("node_id string, block long, bits long, distance int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    start = places.select(F.col("root_id").alias("node_id"), "block", flag.alias("bits"), F.lit(0).alias("distance"))
    found = total = write_counted(start, f"{base}/round=0")
    distance, number = 0, 0

    def onwards(nodes: DataFrame) -> DataFrame:
        inner = nodes.filter(~F.startswith(F.col("node_id"), F.lit(EXTERNAL)))
        return inner.join(steps, "node_id").select(F.col("next_id").alias("node_id"), "block", "bits")

    def together(rows: DataFrame, *names: str) -> DataFrame:
        return rows.groupBy(*key).agg(*[F.bit_or(n).alias(n) for n in names])

    def as_kind(rows: DataFrame, kind: str) -> DataFrame:
        none = F.lit(0).cast("long")
        return rows.select(*key, *[(F.col("bits") if k == kind else none).alias(k) for k in KINDS])

    while found and (depth is None or distance < depth):
        front = rounds.parquet(f"{base}/round={number}").filter(F.col("distance") == distance)
        path = folder(spark, "one")
        size = write_counted(together(onwards(front), "bits"), path)
        one = spark.read.schema("node_id string, block long, bits long").parquet(path)
        parts, new = [as_kind(one, "one")], [(distance + 1, F.col("one"))]
        if depth is None or distance + 2 <= depth:
            parts.append(as_kind(onwards(one), "two"))
            new.append((distance + 2, F.col("two").bitwiseAND(F.bitwise_not("one"))))
        near, reached = _union(parts), rounds.parquet(base).filter(F.col("node_id").isNotNull())
        if total > MANY * size:
            near = stash(together(near, *KINDS), "near")
            reached = only_keys_of(reached, key, near)
        met = together(near.unionByName(as_kind(reached, "seen")), *KINDS)
        unseen = [F.struct(F.lit(d).alias("distance"), c.bitwiseAND(F.bitwise_not("seen")).alias("bits")) for d, c in new]
        fresh = met.select(*key, F.inline(F.array(*unseen))).filter(F.col("bits") != 0)
        distance, number = distance + len(parts), number + 1
        seen = Observation()
        last = F.count_if(F.col("distance") == distance)
        fresh.observe(seen, F.count("*").alias("rows"), last.alias("last")).write.parquet(f"{base}/round={number}")
        found, total = seen.get["last"], total + seen.get["rows"]
    reached = rounds.parquet(base).join(places, "block").filter(F.getbit("bits", "bit") == 1)
    return reached.select("root_id", "node_id", "distance")


def refresh_reachable(
    stored: DataFrame, before: DataFrame, after: DataFrame, roots: DataFrame, direction: str = "upstream"
) -> DataFrame:
    """Reachability over changed edges, from that over the edges before, at any distance.

    ``stored`` is the result of :func:`reachable` for the edges ``before``. A root's nodes can
    differ only if it had reached a node that gained or lost a step (or is new), so the rows of
    such roots are dropped and derived again over ``after``; those of all other roots are kept.
    Roots that ``roots`` lacks go.
    """
    sides = [_neighbours(e, direction).withColumn("_side", F.lit(k)) for k, e in enumerate((before, after))]
    ends = _union(sides).groupBy("node_id", "next_id").agg(F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    touched = stash(ends.filter(F.col("_first") == F.col("_last")).select("node_id").distinct(), "touched")
    wanted = roots.select("root_id").distinct()
    hit = stored.join(touched, "node_id", "left_semi").select("root_id")
    gone = stash(hit.join(wanted, "root_id", "left_semi").distinct(), "affected-roots")
    unseen = wanted.join(stored.select("root_id"), "root_id", "left_anti")
    kept = stored.join(wanted, "root_id", "left_semi").join(gone, "root_id", "left_anti")
    again = reachable(after, gone.unionByName(unseen), None, direction)
    return kept.select("root_id", "node_id", "distance").unionByName(again)


def dataflow_edges(
    edges: DataFrame, reached: DataFrame, depth: int | None = None, direction: str = "upstream"
) -> DataFrame:
    """Edges of the graph around each root: those of all nodes nearer than ``depth``, or of all nodes."""
    near = F.lit(True) if depth is None else F.col("distance") < depth
    opened = reached.filter(
        near & ~F.startswith(F.col("node_id"), F.lit(EXTERNAL))
    ).select("root_id", "node_id")
    ends = {"upstream": ["to_id"], "downstream": ["from_id"], "both": ["to_id", "from_id"]}[direction]
    found = [edges.join(opened, edges[end] == opened["node_id"]).drop("node_id") for end in ends]
    return _union(found).select("root_id", *edges.columns).distinct()


def dataflow_nodes(reached: DataFrame, objects: DataFrame) -> DataFrame:
    """Reached nodes with their names; a node the catalogue lacks is external."""
    known = objects.select(
        F.col("table_id").cast("string").alias("node_id"), "db_name", "table_name", F.lit(True).alias("_known")
    )
    named = reached.join(known, "node_id", "left")
    other = F.when(
        F.startswith(F.col("node_id"), F.lit(EXTERNAL)),
        F.regexp_replace(F.substring("node_id", len(EXTERNAL) + 1, 2**31 - 1), r"^\.", ""),
    ).otherwise(F.concat(F.lit("#"), F.col("node_id")))
    return named.select(
        "root_id", "node_id", "distance", "db_name", F.coalesce("table_name", other).alias("table_name"),
        F.col("_known").isNull().alias("is_external"), (F.col("node_id") == F.col("root_id")).alias("is_root"),
    )


def load_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest path from a parentless node: node_id, level. Parents always have lower levels.

    ``edges`` has parent_id and child_id, ``nodes`` has node_id; edges to other nodes and to
    a node itself are ignored. Round k keeps the edges whose parent still had a parent in
    round k - 1, so a node's level is the number of rounds that contain it as a child. Edges
    that no round removes belong to nodes in or behind a cycle; their level is null.
    """
    spark = edges.sparkSession
    inside = (
        edges.filter(F.col("parent_id") != F.col("child_id"))
        .select("parent_id", "child_id")
        .distinct()
        .join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
        .join(nodes.select(F.col("node_id").alias("child_id")), "child_id", "left_semi")
    )
    base, level = folder(spark, "levels"), 1
    one_round = spark.read.schema(inside.schema)
    size = write_counted(inside, f"{base}/level={level}")
    while size:
        left = one_round.parquet(f"{base}/level={level}")
        parents = left.select(F.col("child_id").alias("parent_id"))
        level += 1
        rest = write_counted(left.join(parents, "parent_id", "left_semi"), f"{base}/level={level}")
        if rest == size:
            break
        size = rest
    all_rounds = spark.read.schema(T.StructType([*inside.schema, T.StructField("level", T.IntegerType())]))
    deepest = all_rounds.parquet(base).groupBy("child_id").agg(F.max("level").alias("_level"))
    looped = one_round.parquet(f"{base}/level={level}").select("child_id").distinct()
    placed = deepest.join(looped.withColumn("_looped", F.lit(True)), "child_id", "left")
    placed = placed.withColumnRenamed("child_id", "node_id")
    return (
        nodes.select("node_id")
        .distinct()
        .join(placed, "node_id", "left")
        .select("node_id", F.when(F.col("_looped").isNull(), F.coalesce("_level", F.lit(0))).alias("level"))
    )


def load_order(jobs: DataFrame, levels: DataFrame) -> DataFrame:
    """Jobs with ``level`` and ``seq``, an order that loads parents first.

    Sorted by level, then job id; jobs in cycles come last.
    """
    placed = levels.select(F.col("node_id").alias("target_table_id"), "level")
    leveled = jobs.join(placed, "target_table_id", "left")
    ordered = leveled.withColumn("_level", F.coalesce("level", F.lit(2**31 - 1)))
    return number_distinct(ordered, "_level", "job_id", position="seq").drop("_level")

"""Reachability, its refresh, catalogue comparison and name search against plain Python."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedimenta.operators import catalog, graph, runlog, substring
from sedimenta.operators.keyed_join import only_keys_of
from sedimenta.operators.substring import matching_pairs

EDGE = "from_id string, to_id string"


def reached(edges, roots, depth=None):
    out = []
    for root in roots:
        seen, front, d = {root: 0}, {root}, 0
        while front and (depth is None or d < depth):
            d += 1
            inner = {n for n in front if not n.startswith("EXT::")}
            front = {a for a, b in edges if b in inner and a not in seen}
            seen.update(dict.fromkeys(front, d))
        out += [(root, n, d) for n, d in seen.items()]
    return sorted(out, key=repr)


def random_edges(seed, nodes=40, count=70):
    pick = random.Random(seed)
    name = lambda: str(pick.randrange(nodes)) if pick.random() < 0.95 else f"EXT::x{pick.randrange(3)}"
    return sorted({(name(), str(pick.randrange(nodes))) for _ in range(count)})


@pytest.mark.parametrize("depth", [0, 3, None])
def test_reachable(spark, depth):
    edges, roots = random_edges(3), ["0", "1", "5", "none"]
    found = graph.reachable(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "root_id string"), depth)
    assert found.columns == ["root_id", "node_id", "distance"]
    assert rows(found) == reached(edges, roots, depth)


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshed_reachability_equals_a_new_one(spark, seed):
    before = random_edges(seed)
    pick = random.Random(seed)
    after = sorted({e for e in before if pick.random() > 0.05} | {(str(pick.randrange(40)), str(pick.randrange(40))) for _ in range(3)})
    old, new = ["0", "1", "2", "3", "9", "17", "EXT::x1"], ["1", "2", "3", "9", "17", "30", "EXT::x1"]
    frame = lambda r: spark.createDataFrame([(x,) for x in r], "root_id string")
    first, second = spark.createDataFrame(before, EDGE), spark.createDataFrame(after, EDGE)
    stored = graph.reachable(first, frame(old))
    assert rows(graph.refresh_reachable(stored, first, second, frame(new))) == reached(after, new)
    assert rows(graph.refresh_reachable(stored, first, first, frame(old))) == reached(before, old)


def test_untouched_roots_are_not_derived_again(spark, monkeypatch):
    before = spark.createDataFrame([("1", "2"), ("2", "3"), ("7", "8")], EDGE)
    after = spark.createDataFrame([("1", "2"), ("2", "3"), ("6", "8")], EDGE)
    roots = spark.createDataFrame([("3",), ("8",)], "root_id string")
    stored = graph.reachable(before, roots)
    asked, real = [], graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda e, r, *a: asked.append(rows(r)) or real(e, r, *a))
    assert rows(graph.refresh_reachable(stored, before, after, roots)) == [("3", "1", 2), ("3", "2", 1), ("3", "3", 0), ("8", "6", 1), ("8", "8", 0)]
    assert asked == [[("8",)]]


def test_equal_steps_to_a_missing_node_touch_no_root(spark, monkeypatch):
    """A step without its end is no change where both versions have it."""
    edges = spark.createDataFrame([(None, "2"), ("2", "3"), ("2", "3")], EDGE)
    roots = spark.createDataFrame([("3",)], "root_id string")
    stored = graph.reachable(edges, roots)
    asked, real = [], graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda e, r, *a: asked.append(rows(r)) or real(e, r, *a))
    refreshed = rows(graph.refresh_reachable(stored, edges, edges.distinct(), roots))
    assert refreshed == rows(stored) == [("3", "2", 1), ("3", "3", 0), ("3", None, 2)] and asked == [[]]


def test_a_round_shuffles_its_own_nodes_only(spark):
    """However much was reached, next to nothing of it passes for a small round."""
    seen = spark.range(100_000).select(F.lit("r").alias("root_id"), F.col("id").cast("string").alias("node_id"))
    near = spark.createDataFrame([("r", "17"), ("r", "new")], "root_id string, node_id string")
    assert only_keys_of(seen, ["root_id", "node_id"], near).count() <= 5


def test_roots_share_the_rows_of_common_nodes(spark, monkeypatch):
    """What many roots have in common goes through the rounds once for a block of them."""
    chain = [(f"c{i + 1}", f"c{i}") for i in range(20)]
    edges = chain + [("c0", f"m{i}") for i in range(4)] + [(f"m{i % 4}", f"r{i}") for i in range(256)]
    roots, made, real = [f"r{i}" for i in range(256)], [], graph.folder
    monkeypatch.setattr(graph, "folder", lambda s, name: made.append(real(s, name)) or made[-1])
    found = graph.reachable(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "root_id string"))
    assert rows(found) == reached(edges, roots)
    stored = next(path for path in made if "/reached-" in path)
    assert spark.read.parquet(stored).count() < 1_000 < found.count() == 256 * 23


@pytest.mark.parametrize("direction", ["upstream", "downstream", "both"])
def test_reachable_from_many_roots(spark, monkeypatch, direction):
    """Several blocks, rows filtered by the round's own nodes, and all directions."""
    monkeypatch.setattr(graph, "MANY", 0)
    edges = random_edges(5, 150, 220)
    turned = [(b, a) for a, b in edges]
    plain = {"upstream": edges, "downstream": turned, "both": sorted({*edges, *turned})}[direction]
    roots = sorted({n for e in edges for n in e})
    assert len(roots) > 128
    found = graph.reachable(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(r,) for r in roots], "root_id string"), 5, direction)
    assert rows(found) == reached(plain, roots, 5)


def test_missing_and_repeated_ids(spark):
    edges = spark.createDataFrame([(None, "b"), ("b", "c"), ("b", "c"), ("x", None)], EDGE)
    roots = spark.createDataFrame([("c",), ("c",), (None,)], "root_id string")
    assert rows(graph.reachable(edges, roots)) == sorted([("c", "c", 0), ("c", "b", 1), ("c", None, 2), (None, None, 0)], key=repr)


def test_levels_of_a_hot_parent(spark):
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("parent_id"), F.col("id").alias("child_id"))
    levels = graph.load_levels(edges, spark.range(3000).withColumnRenamed("id", "node_id"))
    assert rows(levels.groupBy("level").count()) == [(0, 1), (1, 2999)]


# --- catalogues ----------------------------------------------------------------------------

COLUMNS = "column_id long, table_id long, column_name string, position int, column_type string, length int, nullable string"


def _catalogs(spark, tables=30):
    left = [(t * 10 + c, t, f"Col{c}", c, "I4", 4, "Y") for t in range(tables) for c in range(5)]
    right = [(None, t, f"COL{c}", c, "I4 ", 8 if t == 7 and c == 2 else 4, "Y") for t in range(1, tables) for c in range(5) if (t, c) != (9, 1)]
    left += [(901, 50, "twice", 1, "I4", 4, "Y"), (902, 50, "TWICE", 2, "I4", 4, "Y"), (903, None, "x", 1, "I4", 4, "Y"), (904, 51, None, 1, "I4", 4, None)]
    right += [(None, 50, "twice", 1, "I4", 4, "Y"), (None, 50, "TWICE", 2, "I4", 4, "Y"), (None, None, "x", 1, "I4", 4, "Y"), (None, 51, None, 1, "I4", 4, None)]
    return spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS)


def test_equal_tables_stay_out_of_the_join(spark):
    registered, actual = _catalogs(spark)
    equal = catalog._equal_tables(registered, actual, catalog.DRIFT_FACETS)
    assert {r[0] for r in equal.collect()} == set(range(1, 30)) - {7, 9}
    paired = catalog._paired(registered, actual, catalog.DRIFT_FACETS)
    plain = catalog._side(registered, "r").join(catalog._side(actual, "a"), ["table_id", "_name"], "full_outer")
    status = catalog._status(catalog.DRIFT_FACETS).alias("status")
    assert rows(paired.select("table_id", "_name", "r.column_name", status)) == rows(plain.select("table_id", "_name", "r.column_name", status))
    summary = {r["table_id"]: r for r in catalog.drift_summary(catalog.compare_catalogs(registered, actual)).collect()}
    assert summary[7]["changed_count"] == 1 and summary[9]["removed_count"] == 1 and summary[3]["unchanged_count"] == 5
    assert summary[50]["unchanged_count"] == 2 and summary[50]["changed_count"] == 2


def test_digests_ignore_order_and_tell_nulls_from_text(spark):
    base = [(1, 1, "a", 1, None, 4, "x"), (2, 1, "b", 2, "I4", None, "Y")]
    swapped = [(3, 1, "b", 2, "I4", None, "Y"), (4, 1, "a", 1, None, 4, "x")]
    moved = [(1, 1, "a", 1, "x", 4, None), (2, 1, "b", 2, "I4", None, "Y")]
    digest = lambda r: rows(catalog.table_digests(spark.createDataFrame(r, COLUMNS), catalog.DRIFT_FACETS).select("digest"))
    assert digest(base) == digest(swapped) != digest(moved)


# --- names ---------------------------------------------------------------------------------


def test_matching_pairs(spark):
    pick = random.Random(4)
    word = lambda n, letters="abc": "".join(pick.choice(letters) for _ in range(n))
    texts = [(i, word(pick.randint(0, 12))) for i in range(150)] + [(900, None), (901, "a%c"), (902, "x_y")]
    patterns = [word(pick.randint(0, 5), "abc%_") for _ in range(80)] + ["", "%", "_", "____________", "\\%c", "x\\_y", None, "nothing"]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = rows(matching_pairs(t, p))
    like = F.like("text", F.concat(F.lit("%"), "pattern", F.lit("%")))
    assert got == rows(t.crossJoin(p.distinct()).where(like).select("pattern", "id"))


def test_many_names_meet_few_texts(spark):
    """Five thousand names against as many texts, without 25 million comparisons."""
    names = spark.range(5_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    patterns = names.select(F.substring("text", 20, 12).alias("pattern"))
    assert matching_pairs(names, patterns).count() == 5_000


def test_no_text_index_is_broadcast(spark):
    """A small file of names is a large index, which the driver mustn't hold."""
    jobs = spark.range(50).select(F.col("id").alias("job_id"), F.concat(F.lit("LOAD_"), "id").alias("job_name"), F.lit("TPT_LOAD").alias("job_type"))
    runs = spark.createDataFrame([(1, 7, None, "SUCCESS")], "run_id long, job_id long, end_time timestamp, status string")
    status = runlog.import_status(jobs, runs, ["LOAD_7", "OAD_", "none"])
    assert [(r[0], r[2], r[3]) for r in rows(status)] == [("LOAD_7", 7, "SUCCESS"), ("OAD_", 0, None), ("none", None, None)]
    texts, patterns = jobs.select(F.col("job_id").alias("id"), F.col("job_name").alias("text")), jobs.select(F.col("job_name").alias("pattern"))
    assert "Broadcast" not in matching_pairs(texts, patterns)._jdf.queryExecution().executedPlan().toString()


def test_names_of_digits_meet_their_own_texts(spark):
    """A thousand groups of three digits don't tell many numbers apart; the whole number does."""
    names = spark.range(100_000, 106_000).select("id", F.concat(F.lit("LOAD_"), F.col("id").cast("string")).alias("text"))
    patterns = names.select(F.concat(F.lit("LO%_"), F.col("id").cast("string")).alias("pattern"))
    assert substring._met(names, patterns).count() == 6_000
    long = spark.createDataFrame([(1, "x" * 30 + "1"), (2, "x" * 30 + "2" + "x" * 30 + "2"), (3, "x" * 15)], "id long, text string")
    asked = spark.createDataFrame([("x" * 30 + "2",), ("x" * 16,), ("x" * 15,), ("x" * 31,)], "pattern string")
    assert rows(matching_pairs(long, asked)) == sorted(
        [("x" * 30 + "2", 2), *[("x" * 16, i) for i in (1, 2)], *[("x" * 15, i) for i in (1, 2, 3)]], key=repr
    )


def test_few_searches_leave_few_groups(spark, monkeypatch):
    """Texts are indexed by what is looked for, not by all they hold."""
    texts = spark.range(1_000).select("id", F.concat(F.lit("HOLDS BRAND#"), "id").alias("text"))
    asked, real = [], substring.one_per_key
    monkeypatch.setattr(substring, "one_per_key", lambda df, *a: asked.append(df.count()) or real(df, *a))
    found = matching_pairs(texts, spark.createDataFrame([("BRAND#7",), ("none",)], "pattern string"))
    assert found.count() == 111 and asked[0] <= 150

"""Lineage edges, view texts, reachability and load levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from samples import reports  # noqa: F401  (its jobs are used below)
from samples.support import AS_OF, CTX, FIXTURES, fixture, portable, query
from sedimenta.operators import graph, lineage

HALF = "CAST(floor({0} / 2) AS BIGINT)"
THIRD = "CAST(floor({0} / 3) AS BIGINT)"
K2, K3 = HALF.format("o_orderkey"), THIRD.format("o_orderkey")

# One view per order; the priority picks the form of its text.
FIXTURES["views"] = f"""
  SELECT 1000000000 + o_orderkey AS view_id, 'REP' AS db_name, concat('V_', CAST(o_orderkey AS STRING)) AS view_name,
         CASE o_orderpriority
           WHEN '1-URGENT' THEN concat('REPLACE VIEW REP.V_', CAST(o_orderkey AS STRING),
             ' AS WITH base (ID, C1) AS (SELECT x.ID, x.C1 FROM db.t_', CAST({K2} AS STRING),
             ' AS x WHERE x.N = ''a, b FROM none'') SELECT DISTINCT base.ID, "t3"."Odd" AS ODD, UPPER(base.C1) UP FROM base, DB.T_',
             CAST({K3} AS STRING), ' t3 WHERE base.ID = t3.ID')
           WHEN '2-HIGH' THEN concat('create view V_', CAST(o_orderkey AS STRING), ' as select * from v_', CAST({K2} AS STRING))
           WHEN '3-MEDIUM' THEN concat('CREATE VIEW REP.V_', CAST(o_orderkey AS STRING),
             ' AS SELECT s.ID, EXTRACT(YEAR FROM s.D) AS Y, (SELECT MAX(m.V) FROM DB.T_', CAST({K3} AS STRING),
             ' m) AS MX FROM (SELECT ID, D FROM DB.T_', CAST({K2} AS STRING), ') s')
           WHEN '4-NOT SPECIFIED' THEN concat('CREATE VIEW REP.V_', CAST(o_orderkey AS STRING),
             ' AS SELECT a.C1, CAST(a.C2 AS DECIMAL(10,2)) AS C2, CASE WHEN b.C3 > 0 THEN ''x, y'' ELSE constant_b.C3 END AS C3,',
             ' a.C4 + COALESCE(b.C5, 0) FROM DB.T_', CAST({K2} AS STRING), ' a -- from DB.OLD', chr(10), ' LEFT JOIN DB.T_', CAST({K3} AS STRING),
             ' b ON a.ID = b.ID /* join DB.GONE */ WHERE a.C1 > 1')
           ELSE concat('CREATE VIEW REP.V_', CAST(o_orderkey AS STRING), ' AS SELECT 1 AS ONE, CURRENT_DATE AS D')
         END AS ddl,
         o_orderkey, o_orderpriority
  FROM orders
"""
FIXTURES["objects"] = """
  SELECT p_partkey AS table_id, 'DB' AS db_name, concat('T_', CAST(p_partkey AS STRING)) AS table_name FROM part
  UNION ALL
  SELECT 1000000000 + o_orderkey, 'REP', concat('V_', CAST(o_orderkey AS STRING)) FROM orders
"""
# Sources as they follow from the way each text was put together.
FIXTURES["expected_sources"] = f"""
  SELECT DISTINCT * FROM (
    SELECT view_id, 'DB' AS source_db, 'T_' || {K2} AS source_name FROM views WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')
    UNION ALL
    SELECT view_id, 'DB', 'T_' || {K3} FROM views WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')
    UNION ALL
    SELECT view_id, NULL, 'V_' || {K2} FROM views WHERE o_orderpriority = '2-HIGH' AND {K2} <> o_orderkey) s
"""
FIXTURES["resolved_sources"] = """
  SELECT s.*, (SELECT min(o.table_id) FROM objects o WHERE upper(o.table_name) = s.source_name
               AND (s.source_db IS NULL OR upper(o.db_name) = s.source_db)) AS source_id
  FROM expected_sources s
"""
FIXTURES["expected_view_edges"] = """
  SELECT DISTINCT COALESCE(CAST(source_id AS VARCHAR), 'EXT::' || COALESCE(source_db, '') || '.' || source_name) AS from_id,
         CAST(view_id AS VARCHAR) AS to_id, 'VIEW' AS edge_type
  FROM resolved_sources
"""


@query("SELECT * FROM expected_sources")
def view_sources(spark, sf_dir):
    return lineage.view_sources(fixture(spark, sf_dir, "views"))


@query("SELECT * FROM resolved_sources")
def resolved_view_sources(spark, sf_dir):
    sources = lineage.view_sources(fixture(spark, sf_dir, "views"))
    return lineage.resolve_objects(sources, fixture(spark, sf_dir, "objects"))


# Texts in which a comma list goes on after a derived table, and texts where none does.
FIXTURES["list_texts"] = """
  SELECT o_orderkey AS view_id, concat('SELECT * FROM ', CASE o_orderstatus
    WHEN 'O' THEN '(SELECT a, b FROM DB.T_1) d, DB.T_2 e' WHEN 'F' THEN 'DB.T_3 c, (SELECT a, b FROM DB.T_1) d WHERE c.x IN (1, 2)'
    ELSE 'DB.T_1 a, DB.T_2 b' END) AS ddl, o_orderstatus
  FROM orders
"""


@query("SELECT view_id FROM list_texts WHERE o_orderstatus = 'O'")
def views_with_unread_lists(spark, sf_dir):
    return lineage.unread_views(fixture(spark, sf_dir, "list_texts"))


def _edges(spark, sf_dir):
    sources = lineage.view_sources(fixture(spark, sf_dir, "views"))
    resolved = lineage.resolve_objects(sources, fixture(spark, sf_dir, "objects"))
    return lineage.all_edges(fixture(spark, sf_dir, "jobs"), lineage.view_edges(resolved))


@query("""
  SELECT CAST(source_table_id AS VARCHAR) AS from_id, CAST(target_table_id AS VARCHAR) AS to_id, 'ETL' AS edge_type,
         job_id, job_name
  FROM jobs WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL
  UNION ALL SELECT from_id, to_id, edge_type, NULL, NULL FROM expected_view_edges
""")
def lineage_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("""
  SELECT CAST(source_table_id AS VARCHAR) AS node_id, CAST(target_table_id AS VARCHAR) AS consumer_id, 'ETL' AS edge_type
  FROM jobs WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL
  UNION SELECT from_id, to_id, edge_type FROM expected_view_edges
""")
def object_consumers(spark, sf_dir):
    return lineage.consumers(_edges(spark, sf_dir))


@query("SELECT view_id, sha256(ddl) AS ddl_hash FROM views")
def view_text_hashes(spark, sf_dir):
    v = fixture(spark, sf_dir, "views")
    return v.select("view_id", lineage.ddl_hash(F.col("ddl")).alias("ddl_hash"))


# --- incremental parsing: some views stored with their hash, some with an outdated one ----

FIXTURES["stored_views"] = """
  SELECT view_id, o_orderpriority, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'outdated' END AS old_hash, ddl,
         o_orderkey
  FROM views WHERE o_orderpriority <> '1-URGENT'
"""


@query("""
  WITH parsed AS (
    SELECT v.view_id, r.source_id, r.source_db, r.source_name, sha256(v.ddl) AS ddl_hash, '2024-02-01 00:00:00.000000' AS parsed_at
    FROM views v LEFT JOIN resolved_sources r ON r.view_id = v.view_id
    WHERE v.o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED'))
  SELECT * FROM parsed UNION ALL
  SELECT s.view_id, NULL, 'KEPT', 'ROW_' || s.o_orderkey, sha256(s.ddl), '2024-01-30 00:00:00.000000'
  FROM stored_views s WHERE old_hash IS NULL
""")
def refreshed_view_lineage(spark, sf_dir):
    stored = fixture(spark, sf_dir, "stored_views").select(
        "view_id",
        F.lit(None).cast("long").alias("source_id"),
        F.lit("KEPT").alias("source_db"),
        F.concat(F.lit("ROW_"), F.col("o_orderkey").cast("string")).alias("source_name"),
        F.coalesce("old_hash", lineage.ddl_hash(F.col("ddl"))).alias("ddl_hash"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("parsed_at"),
    )
    views, objects = fixture(spark, sf_dir, "views"), fixture(spark, sf_dir, "objects")
    return portable(lineage.refresh_view_lineage(views, stored, objects, CTX))


# --- column mappings -------------------------------------------------------------------


def _columns_sql(rows: dict[str, list[tuple[str, str, str]]]) -> str:
    """Expected (target, kind, sources) per text form; the sources may use the view's numbers."""
    parts = []
    for priority, columns in rows.items():
        for position, (target, kind, sources) in enumerate(columns, start=1):
            parts.append(
                f"SELECT view_id, {position} AS position, '{target}' AS target_column, '{kind}' AS transform_type, "
                f"{sources} AS sources FROM views WHERE o_orderpriority = '{priority}'"
            )
    return "\n UNION ALL ".join(parts)


# The select items of the views, one row each.
ITEMS = {
    "1-URGENT": [("'base.ID'", "'ID'"), ("""'"t3"."Odd"'""", "'ODD'"), ("'UPPER(base.C1)'", "'UP'")],
    "2-HIGH": [("'*'", "'*'")],
    "3-MEDIUM": [
        ("'s.ID'", "'ID'"), ("'EXTRACT(YEAR FROM s.D)'", "'Y'"),
        (f"concat('(SELECT MAX(m.V) FROM DB.T_', CAST({K3} AS STRING), ' m)')", "'MX'"),
    ],
    "4-NOT SPECIFIED": [
        ("'a.C1'", "'C1'"), ("'CAST(a.C2 AS DECIMAL(10,2))'", "'C2'"),
        ("'CASE WHEN b.C3 > 0 THEN ''x, y'' ELSE constant_b.C3 END'", "'C3'"),
        ("'a.C4 + COALESCE(b.C5, 0)'", "'a.C4 + COALESCE(b.C5, 0)'"),
    ],
    "5-LOW": [("'1'", "'ONE'"), ("'CURRENT_DATE'", "'D'")],
}
FIXTURES["view_items"] = " UNION ALL ".join(
    f"SELECT view_id, {position} AS position, {expression} AS expression, {target} AS target_column "
    f"FROM views WHERE o_orderpriority = '{priority}'"
    for priority, items in ITEMS.items()
    for position, (expression, target) in enumerate(items, start=1)
)
T2, T3 = f"'DB.T_' || {K2}", f"'DB.T_' || {K3}"


@query(
    _columns_sql(
        {
            "1-URGENT": [
                ("ID", "DIRECT", "'base.ID'"),
                ("ODD", "DIRECT", f"{T3} || '.Odd'"),
                ("UP", "COMPUTED", "'base.C1'"),
            ],
            "2-HIGH": [("*", "ALL_COLUMNS", "''")],
            "3-MEDIUM": [
                ("ID", "DIRECT", "'ID'"),
                ("Y", "COMPUTED", "'D'"),
                ("MX", "COMPUTED", f"{T3} || '.V'"),
            ],
            "4-NOT SPECIFIED": [
                ("C1", "DIRECT", f"{T2} || '.C1'"),
                ("C2", "CAST", f"{T2} || '.C2'"),
                ("C3", "CASE", f"{T3} || '.C3,C3'"),
                ("a.C4 + COALESCE(b.C5, 0)", "COMPUTED", f"{T2} || '.C4,' || {T3} || '.C5'"),
            ],
            "5-LOW": [("ONE", "COMPUTED", "''"), ("D", "COMPUTED", "''")],
        }
    )
)
def view_column_mapping(spark, sf_dir):
    mapped = lineage.view_columns(fixture(spark, sf_dir, "views"), fixture(spark, sf_dir, "view_items"))
    joined = F.array_join(F.transform("sources", lambda s: F.concat_ws(".", s["table"], s["column"])), ",")
    return mapped.select("view_id", "position", "target_column", "transform_type", joined.alias("sources"))


@query(
    "SELECT view_id, position, target_column, transform_type, split_part(sources, '|', 1) AS source_columns, "
    "split_part(sources, '|', 2) AS constant_columns FROM ("
    + _columns_sql(
        {
            "1-URGENT": [
                ("ID", "DIRECT_MAPPING", "'ID|'"),
                ("ODD", "DIRECT_MAPPING", "'Odd|'"),
                ("UP", "DIRECT_MAPPING", "'C1|'"),
            ],
            "2-HIGH": [("*", "DIRECT_MAPPING", "'|'")],
            "3-MEDIUM": [
                ("ID", "DIRECT_MAPPING", "'ID|'"),
                ("Y", "DIRECT_MAPPING", "'D|'"),
                ("MX", "DIRECT_MAPPING", "'V|'"),
            ],
            "4-NOT SPECIFIED": [
                ("C1", "DIRECT_MAPPING", "'C1|'"),
                ("C2", "TYPE_CONVERSION", "'C2|'"),
                ("C3", "CONDITIONAL_LOGIC", "'C3|C3'"),
                ("a.C4 + COALESCE(b.C5, 0)", "DIRECT_MAPPING", "'C4,C5|'"),
            ],
            "5-LOW": [("ONE", "DIRECT_MAPPING", "'|'"), ("D", "DIRECT_MAPPING", "'|'")],
        }
    )
    + ") x"
)
def statement_column_mapping(spark, sf_dir):
    mapped = lineage.statement_columns(fixture(spark, sf_dir, "view_items"))
    return mapped.select(
        "view_id", "position", "target_column", "transform_type",
        F.array_join("source_columns", ",").alias("source_columns"),
        F.array_join("constant_columns", ",").alias("constant_columns"),
    )


# --- reachability ----------------------------------------------------------------------

P2, P3 = HALF.format("p_partkey"), THIRD.format("p_partkey")
FIXTURES["part_edges"] = f"""
  SELECT CAST({P2} AS STRING) AS from_id, CAST(p_partkey AS STRING) AS to_id, 'ETL' AS edge_type, p_partkey AS job_id
  FROM part WHERE p_partkey > 0
  UNION ALL
  SELECT CAST({P3} AS STRING), CAST(p_partkey AS STRING), 'VIEW', CAST(NULL AS BIGINT) FROM part WHERE p_partkey > 0
  UNION ALL
  SELECT CAST(p_partkey AS STRING), CAST({P2} AS STRING), 'ETL', -p_partkey
  FROM part WHERE p_brand = 'Brand#7' AND p_partkey > 0
  UNION ALL
  SELECT concat('EXT::.S_', p_type), CAST(p_partkey AS STRING), 'VIEW', CAST(NULL AS BIGINT) FROM part WHERE p_size = 1
"""
FIXTURES["part_objects"] = """
  SELECT p_partkey AS table_id, 'DB' AS db_name, p_name AS table_name FROM part WHERE p_type <> 'PROMO'
"""
UP_STEPS = "SELECT to_id AS node, from_id AS next FROM part_edges"
DOWN_STEPS = "SELECT from_id AS node, to_id AS next FROM part_edges"


def reach_sql(steps: str, depth: int, roots: str) -> str:
    return f"""
      WITH RECURSIVE hops AS ({steps}), r(root_id, node_id, d) AS (
        SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey AS VARCHAR), 0 FROM {roots}
        UNION
        SELECT r.root_id, s.next, r.d + 1 FROM r JOIN hops s ON s.node = r.node_id
        WHERE r.d < {depth} AND NOT starts_with(r.node_id, 'EXT::')),
      reached AS (SELECT root_id, node_id, min(d) AS distance FROM r GROUP BY root_id, node_id)
    """


def _reach(spark, sf_dir, depth: int, direction: str):
    edges = fixture(spark, sf_dir, "part_edges")
    roots = fixture(spark, sf_dir, "part_roots").select(F.col("p_partkey").cast("string").alias("root_id"))
    return edges, graph.reachable(edges, roots, depth, direction)


FIXTURES["part_roots"] = "SELECT p_partkey FROM part"


@query(reach_sql(UP_STEPS, 12, "part_roots") + " SELECT * FROM reached")
def reachable_upstream(spark, sf_dir):
    return _reach(spark, sf_dir, 12, "upstream")[1]


@query(
    reach_sql(DOWN_STEPS, 3, "part_roots")
    + """ SELECT DISTINCT r.root_id, e.from_id, e.to_id, e.edge_type, e.job_id
          FROM reached r JOIN part_edges e ON e.from_id = r.node_id
          WHERE r.distance < 3 AND NOT starts_with(r.node_id, 'EXT::') """
)
def dataflow_edges_downstream(spark, sf_dir):
    edges, reached = _reach(spark, sf_dir, 3, "downstream")
    return graph.dataflow_edges(edges, reached, 3, "downstream")


@query(
    reach_sql(f"{UP_STEPS} UNION ALL {DOWN_STEPS}", 2, "part_roots")
    + """ SELECT r.root_id, r.node_id, r.distance, o.db_name,
                 COALESCE(o.table_name, CASE WHEN starts_with(r.node_id, 'EXT::') THEN substr(r.node_id, 7)
                                        ELSE '#' || r.node_id END) AS table_name,
                 o.table_id IS NULL AS is_external, r.node_id = r.root_id AS is_root
          FROM reached r LEFT JOIN part_objects o ON CAST(o.table_id AS VARCHAR) = r.node_id """
)
def dataflow_nodes_both(spark, sf_dir):
    reached = _reach(spark, sf_dir, 2, "both")[1]
    return graph.dataflow_nodes(reached, fixture(spark, sf_dir, "part_objects"))


# --- lineage after a change ------------------------------------------------------------

# A second catalogue version: some view edges are gone, some lead elsewhere.
FIXTURES["later_edges"] = f"""
  SELECT * FROM part_edges WHERE job_id IS NOT NULL OR CAST(to_id AS BIGINT) % 97 <> 5
  UNION ALL
  SELECT CAST({P2} + 1 AS STRING), CAST(p_partkey AS STRING), 'VIEW', CAST(NULL AS BIGINT) FROM part WHERE p_partkey % 97 = 5
"""
# Every seventieth part, and a few that the first version didn't ask for.
FIXTURES["lineage_roots"] = "SELECT p_partkey FROM part WHERE p_partkey % 70 = 9"
FIXTURES["later_roots"] = "SELECT p_partkey FROM part WHERE p_partkey % 70 = 9 AND p_size > 3 OR p_partkey % 700 = 8"


def _roots(spark, sf_dir, name: str):
    return fixture(spark, sf_dir, name).select(F.col("p_partkey").cast("string").alias("root_id"))


@query(reach_sql(UP_STEPS, 1000, "lineage_roots") + " SELECT * FROM reached")
def reachable_from_roots(spark, sf_dir):
    """Any distance, from a small table of roots."""
    return graph.reachable(fixture(spark, sf_dir, "part_edges"), _roots(spark, sf_dir, "lineage_roots"))


@query(reach_sql("SELECT to_id AS node, from_id AS next FROM later_edges", 1000, "later_roots") + " SELECT * FROM reached")
def refreshed_reachability(spark, sf_dir):
    before, after = (fixture(spark, sf_dir, n) for n in ("part_edges", "later_edges"))
    stored = graph.reachable(before, _roots(spark, sf_dir, "lineage_roots"))
    return graph.refresh_reachable(stored, before, after, _roots(spark, sf_dir, "later_roots"))


# --- load levels -----------------------------------------------------------------------

FIXTURES["parent_edges"] = f"""
  SELECT {P2} AS parent_id, p_partkey AS child_id FROM part
  UNION ALL SELECT {P3}, p_partkey FROM part
  UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_type = 'SMALL' AND p_size > 25
  UNION ALL SELECT p_partkey, -5 FROM part WHERE p_size = 2
"""
FIXTURES["cycle_edges"] = f"""
  SELECT * FROM parent_edges
  UNION ALL SELECT p_partkey AS parent_id, {P2} AS child_id FROM part WHERE p_brand = 'Brand#7' AND p_partkey > 20
"""
LEVELS = """
  WITH RECURSIVE e AS (SELECT DISTINCT parent_id, child_id FROM parent_edges
                       WHERE parent_id <> child_id AND child_id IN (SELECT p_partkey FROM part)),
  walk(node_id, level) AS (
    SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT child_id FROM e)
    UNION SELECT e.child_id, w.level + 1 FROM walk w JOIN e ON e.parent_id = w.node_id),
  levels AS (SELECT node_id, max(level) AS level FROM walk GROUP BY node_id)
"""


def _levels(spark, sf_dir, edges: str):
    nodes = fixture(spark, sf_dir, "part_roots").select(F.col("p_partkey").alias("node_id"))
    return graph.load_levels(fixture(spark, sf_dir, edges), nodes)


@query(LEVELS + " SELECT * FROM levels")
def load_levels(spark, sf_dir):
    return _levels(spark, sf_dir, "parent_edges")


@query(
    LEVELS
    + f""", looped(node_id) AS (
        SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_partkey > 20
        UNION SELECT {P2} FROM part WHERE p_brand = 'Brand#7' AND p_partkey > 20
        UNION SELECT e.child_id FROM looped l JOIN e ON e.parent_id = l.node_id)
      SELECT l.node_id, CASE WHEN l.node_id IN (SELECT node_id FROM looped) THEN NULL ELSE level END AS level
      FROM levels l """
)
def load_levels_with_cycles(spark, sf_dir):
    return _levels(spark, sf_dir, "cycle_edges")


@query(
    LEVELS
    + """ SELECT j.job_id, l.level, ROW_NUMBER() OVER (ORDER BY l.level NULLS LAST, j.job_id) AS seq
          FROM jobs j LEFT JOIN levels l ON j.target_table_id = l.node_id """
)
def job_load_order(spark, sf_dir):
    ordered = graph.load_order(fixture(spark, sf_dir, "jobs"), _levels(spark, sf_dir, "parent_edges"))
    return ordered.select("job_id", "level", "seq")

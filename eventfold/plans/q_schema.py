"""Queries: schema log, quarantine, validation, workflow rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import edges, gate, schema_log, validate, workflow
from eventfold.plans import catalog
from eventfold.plans.adapters import (
    edge_log,
    item_changes,
    micros,
    order_items,
    schema_changes,
    table,
    tag,
    with_parts,
)
from eventfold.plans.q_edges import LIVE
from eventfold.plans.registry import query

REACHED = {
    "bumped": """SELECT *, sum(CASE WHEN kind IN ('schema.init', 'schema.snapshot') THEN 1 ELSE 0 END) OVER
    (PARTITION BY project_uuid ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS seg FROM schema_log
    WHERE kind IN ('schema.init', 'schema.snapshot', 'schema.add-field')""",
    "reached": """SELECT *, CASE WHEN seg > 0 THEN CAST(max(CASE kind WHEN 'schema.init' THEN 1
      WHEN 'schema.snapshot' THEN given_version END) OVER (PARTITION BY project_uuid, seg)
    + sum(CASE WHEN kind = 'schema.add-field' THEN 1 ELSE 0 END) OVER (PARTITION BY project_uuid, seg ORDER BY {o}
      ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS version FROM bumped""",
}
LEDGER = {
    **REACHED,
    "ledger": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_uuid, version ORDER BY {desc}) AS rn
    FROM reached WHERE version IS NOT NULL) WHERE rn = 1""",
}


@query(
    "v1_schema_versions",
    with_parts(["schema_log"], "SELECT event_uuid, project_uuid, kind, version FROM reached", REACHED),
)
def schema_versions(spark, sf):
    """Version reached by each init, snapshot and field event; NULL before any schema."""
    return schema_log.versions(schema_changes(spark, sf)).select("event_uuid", "project_uuid", "kind", "version")


@query(
    "v1_schema_ledger",
    with_parts(["schema_log"], "SELECT project_uuid, version, event_uuid, kind FROM ledger", LEDGER),
)
def schema_ledger(spark, sf):
    """One row per project and version; later events replace the same version."""
    return schema_log.ledger(schema_log.versions(schema_changes(spark, sf))).select(
        "project_uuid", "version", "event_uuid", "kind"
    )


BODIES = {
    "bodies": """SELECT project_uuid, {o}, 'bug' AS item_type, 'issue' AS entity_kind, 'title' AS field,
        'text' AS field_kind, TRUE AS required FROM schema_log WHERE kind IN ('schema.init', 'schema.snapshot')
      UNION ALL SELECT project_uuid, {o}, 'bug', 'issue', field, 'number', FALSE FROM schema_log
        WHERE kind IN ('schema.init', 'schema.snapshot')
      UNION ALL SELECT project_uuid, {o}, type_name, entity_kind, 'note', 'url', FALSE FROM schema_log
        WHERE kind IN ('schema.init', 'schema.snapshot')"""
}


@query(
    "v2_schema_fields",
    with_parts(
        ["schema_log"],
        """SELECT project_uuid, entity_kind, item_type, field, field_kind, required FROM (SELECT *, row_number() OVER
        (PARTITION BY project_uuid, entity_kind, item_type, field ORDER BY {desc}) AS rn FROM defs) WHERE rn = 1""",
        {
            **BODIES,
            "since": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_uuid ORDER BY {desc}) AS rn
              FROM schema_log WHERE kind IN ('schema.init', 'schema.snapshot')) WHERE rn = 1""",
            "own": "SELECT b.* FROM bodies b JOIN since s ON s.event_uuid = b.event_uuid",
            "added": """SELECT a.* FROM schema_log a JOIN since s ON s.project_uuid = a.project_uuid
              WHERE a.kind = 'schema.add-field' AND (a.hlc_us, a.hlc_node, a.hlc_seq, a.node_uuid, a.stream_seq)
                > (s.hlc_us, s.hlc_node, s.hlc_seq, s.node_uuid, s.stream_seq)""",
            "kinds": "SELECT DISTINCT project_uuid, entity_kind, item_type FROM own",
            "defs": """SELECT * FROM own UNION ALL SELECT a.project_uuid, a.hlc_us, a.hlc_ns, a.hlc_node, a.hlc_seq,
                a.node_uuid, a.stream_seq, a.event_uuid, coalesce(k.item_type, CASE a.entity_kind WHEN 'issue' THEN 'bug'
                WHEN 'effort' THEN 'sprint' ELSE 'module' END), a.entity_kind, a.field, a.field_kind, a.required
              FROM added a LEFT JOIN kinds k ON k.project_uuid = a.project_uuid AND k.entity_kind = a.entity_kind""",
        },
    ),
)
def schema_fields(spark, sf):
    """Declared fields per type under the latest schema of each project."""
    return schema_log.field_table(schema_changes(spark, sf)).select(
        "project_uuid", "entity_kind", "item_type", "field", "field_kind", "required"
    )


@query(
    "v3_schema_bodies",
    with_parts(
        ["schema_log"],
        "SELECT event_uuid, project_uuid, item_type, entity_kind, field, field_kind, required FROM bodies",
        BODIES,
    ),
)
def schema_bodies(spark, sf):
    """JSON schema bodies as rows, one per type and field."""
    return schema_log.body_fields(schema_changes(spark, sf)).select(
        "event_uuid", "project_uuid", "item_type", "entity_kind", "field", "field_kind", "required"
    )


@query(
    "v4_latest_schema",
    with_parts(
        ["schema_log"],
        """SELECT project_uuid, version, event_uuid, kind, n AS versions_from_50 FROM (SELECT *, row_number() OVER
          (PARTITION BY project_uuid ORDER BY version DESC) AS r, count(*) FILTER (version >= 50) OVER
          (PARTITION BY project_uuid) AS n FROM ledger) WHERE r = 1""",
        LEDGER,
    ),
)
def latest_schema(spark, sf):
    """Highest version per project, and how many of its versions reach a given one."""
    rows = schema_log.ledger(schema_log.versions(schema_changes(spark, sf)))
    from_50 = schema_log.at_least(rows, 50).groupBy("project_uuid").agg(F.count(F.lit(1)).alias("n"))
    return (
        schema_log.latest(rows)
        .join(from_50, "project_uuid", "left")
        .select("project_uuid", "version", "event_uuid", "kind", F.coalesce("n", F.lit(0)).alias("versions_from_50"))
    )


@query(
    "v5_migrations",
    with_parts(
        ["schema_log"],
        """SELECT project_uuid, register, name, value, live, event_uuid FROM (SELECT *, row_number() OVER
        (PARTITION BY project_uuid, register, name ORDER BY {desc}) AS rn FROM writes) WHERE rn = 1""",
        {
            "writes": """SELECT *, 'item_type' AS register, type_name AS name, entity_kind AS value, TRUE AS live
                FROM schema_log WHERE kind = 'schema.add-item-type'
              UNION ALL SELECT *, 'field', type_name || '.' || field, NULL, FALSE FROM schema_log
                WHERE kind IN ('schema.remove-field', 'schema.rename-field')
              UNION ALL SELECT *, 'field', type_name || '.' || new_field, field, TRUE FROM schema_log
                WHERE kind = 'schema.rename-field'
              UNION ALL SELECT *, 'field', type_name || '.' || field, field_kind, TRUE FROM schema_log
                WHERE kind = 'schema.change-field-type'
              UNION ALL SELECT *, 'enum', enum_name || '.' || enum_value, NULL, TRUE FROM schema_log
                WHERE kind = 'schema.add-enum-value'
              UNION ALL SELECT *, 'enum', enum_name || '.' || enum_value, NULL, FALSE FROM schema_log
                WHERE kind = 'schema.rename-enum-value'
              UNION ALL SELECT *, 'enum', enum_name || '.' || new_value, enum_value, TRUE FROM schema_log
                WHERE kind = 'schema.rename-enum-value'
              UNION ALL SELECT *, 'relation_kind', relation_kind, NULL, TRUE FROM schema_log
                WHERE kind = 'schema.add-relation-kind'
              UNION ALL SELECT *, 'compatibility', 'policy', policy, TRUE FROM schema_log
                WHERE kind = 'schema.set-compatibility'"""
        },
    ),
)
def migrations(spark, sf):
    """Types, fields, enum values, relation kinds and policy after all migrations."""
    return schema_log.migrations(schema_changes(spark, sf)).select(
        "project_uuid", "register", "name", "value", "live", "event_uuid"
    )


@query(
    "v6_quarantine_gate",
    with_parts(
        ["changes"],
        """SELECT c.event_uuid, c.project_uuid, c.schema_version, p.version AS available
        FROM changes c LEFT JOIN projects p ON p.project_uuid = c.project_uuid
        WHERE p.version IS NULL OR c.schema_version > p.version""",
        {"projects": catalog.SQL["projects"]},
    ),
)
def quarantine_gate(spark, sf):
    """Work events held back: no schema, or ahead of it."""
    log = item_changes(table(spark, sf, "events"))
    return (
        gate.gate(log, catalog.projects(spark))
        .where("quarantined")
        .select("event_uuid", "project_uuid", "schema_version", F.col("version").alias("available"))
    )


def shipped_work(spark, sf):
    """Line items as work events on the projects of the schema log."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.lit("w"), o, "l_linenumber", p, "l_suppkey", F.col("l_quantity").cast("bigint")).alias("event_uuid"),
        tag("S", o % 41).alias("project_uuid"),
        micros(F.col("l_shipdate")).alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        F.lit("N1").alias("hlc_node"),
        F.lit(0).cast("bigint").alias("hlc_seq"),
        F.lit("N1").alias("node_uuid"),
        p.alias("stream_seq"),
        (p % 130).alias("schema_version"),
    )


@query(
    "v7_quarantine_drain",
    with_parts(
        ["schema_log"],
        """SELECT event_uuid, project_uuid, need AS schema_version, version_then, CASE WHEN need <= version_then
          THEN 'applied' WHEN need <= later THEN 'drained' ELSE 'quarantined' END AS outcome
        FROM (SELECT *, max(version) OVER (PARTITION BY project_uuid, turn) AS version_then,
            max(version) OVER (PARTITION BY project_uuid ORDER BY {o} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
            AS later FROM (SELECT *, count(version) OVER (PARTITION BY project_uuid ORDER BY {o}
              ROWS UNBOUNDED PRECEDING) AS turn FROM both_logs)) WHERE need IS NOT NULL""",
        {
            **REACHED,
            "both_logs": """SELECT event_uuid, project_uuid, hlc_us, hlc_ns, hlc_node, hlc_seq, node_uuid, stream_seq,
                version, CAST(NULL AS BIGINT) AS need FROM reached WHERE version IS NOT NULL
              UNION ALL SELECT concat_ws('-', 'w', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                CAST(l_quantity AS BIGINT)), 'S' || (l_orderkey % 41), epoch_us(l_shipdate), 0, 'N1', 0, 'N1',
                l_partkey, NULL, l_partkey % 130 FROM lineitem""",
        },
    ),
)
def quarantine_drain(spark, sf):
    """Work events against schema versions over time: applied, drained later, or held."""
    return gate.drain(shipped_work(spark, sf), schema_log.versions(schema_changes(spark, sf)))


V13 = """SELECT project_uuid, from_uuid AS entity_uuid, 'missing_entity_ref' AS conflict_type, 'to_uuid' AS field,
    relation_uuid AS detail FROM live WHERE to_uuid NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size % 10 <> 0)
  UNION ALL SELECT project_uuid, from_uuid, 'missing_entity_ref', 'from_uuid', relation_uuid FROM live
    WHERE from_uuid NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""


@query("v13_dangling_relations", with_parts(["edges"], V13, LIVE))
def dangling_relations(spark, sf):
    """Live relations to or from an entity that has no header; the edge is kept."""
    live = edges.live(edges.relations(edge_log(spark, sf)))
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(tag("O", F.col("o_orderkey")).alias("entity_uuid"))
    parts = table(spark, sf, "part").where("p_size % 10 <> 0").select(tag("P", F.col("p_partkey")).alias("entity_uuid"))
    return validate.dangling(live, orders.unionByName(parts))


def catalogs(spark, sf):
    """State, label, workflow and type catalogs of fifty projects."""
    p, c, o = F.col("p_partkey"), F.col("c_custkey"), F.col("o_orderkey")
    proj = lambda n: tag("K", n % 50)
    slot = F.floor(p / 50) % 40
    states = table(spark, sf, "part").select(
        proj(p).alias("project_uuid"),
        tag("s", p).alias("state"),
        F.when(p % 9 == 0, F.lit("red")).when(p % 31 == 0, F.lit("#12345")).otherwise(F.lit("#a0b1c2")).alias("color"),
        ((slot == 0) & (p % 50 % 10 != 0) | (slot == 1) & (p % 50 % 10 == 1)).alias("is_default"),
    )
    labels = table(spark, sf, "customer").select(
        proj(c).alias("project_uuid"),
        c.alias("idx"),
        F.when(c % 17 == 0, F.lit("")).otherwise(tag("lab", F.floor(c / 50) % 23)).alias("name"),
    )
    base = table(spark, sf, "orders")
    at = lambda n: tag("s", o % 50 + 50 * (n % 45))
    workflow_states = base.select(proj(o).alias("project_uuid"), tag("w", o % 100).alias("workflow"), at(o).alias("state")).distinct()
    workflow_types = base.select(proj(o).alias("project_uuid"), tag("w", o % 100).alias("workflow"), tag("t", o % 13).alias("type")).distinct()
    moves = base.select(
        proj(o).alias("project_uuid"), tag("w", o % 100).alias("workflow"), at(o).alias("from_state"), at(o + 7).alias("to_state")
    ).distinct()
    types = (
        table(spark, sf, "customer")
        .groupBy(proj(c).alias("project_uuid"), tag("t", F.floor(c / 50) % 11).alias("type"))
        .agg(F.max(tag("w", c % 120)).alias("workflow"))
    )
    projects = labels.select("project_uuid").distinct()
    return projects, states, labels, workflow_states, workflow_types, moves, types


CATALOGS = {
    "k_states": """SELECT 'K' || (p_partkey % 50) AS project_uuid, 's' || p_partkey AS state,
      CASE WHEN p_partkey % 9 = 0 THEN 'red' WHEN p_partkey % 31 = 0 THEN '#12345' ELSE '#a0b1c2' END AS color,
      (p_partkey // 50 % 40 = 0 AND p_partkey % 50 % 10 <> 0) OR (p_partkey // 50 % 40 = 1 AND p_partkey % 50 % 10 = 1)
        AS is_default FROM part""",
    "k_labels": """SELECT 'K' || (c_custkey % 50) AS project_uuid, c_custkey AS idx, CASE WHEN c_custkey % 17 = 0
      THEN '' ELSE 'lab' || (c_custkey // 50 % 23) END AS name FROM customer""",
    "k_wstates": """SELECT DISTINCT 'K' || (o_orderkey % 50) AS project_uuid, 'w' || (o_orderkey % 100) AS workflow,
      's' || (o_orderkey % 50 + 50 * (o_orderkey % 45)) AS state FROM orders""",
    "k_wtypes": """SELECT DISTINCT 'K' || (o_orderkey % 50) AS project_uuid, 'w' || (o_orderkey % 100) AS workflow,
      't' || (o_orderkey % 13) AS type FROM orders""",
    "k_moves": """SELECT DISTINCT 'K' || (o_orderkey % 50) AS project_uuid, 'w' || (o_orderkey % 100) AS workflow,
      's' || (o_orderkey % 50 + 50 * (o_orderkey % 45)) AS from_state,
      's' || (o_orderkey % 50 + 50 * ((o_orderkey + 7) % 45)) AS to_state FROM orders""",
    "k_types": """SELECT 'K' || (c_custkey % 50) AS project_uuid, 't' || (c_custkey // 50 % 11) AS type,
      max('w' || (c_custkey % 120)) AS workflow FROM customer GROUP BY 1, 2""",
}
CATALOG_SQL = """SELECT project_uuid, 'states' AS file, 'states' AS path, 'missing_field' AS code FROM
    (SELECT DISTINCT project_uuid FROM k_labels) WHERE project_uuid NOT IN (SELECT project_uuid FROM k_states)
  UNION ALL SELECT project_uuid, 'states', 'states', 'invariant' FROM k_states GROUP BY project_uuid
    HAVING count(*) FILTER (is_default) <> 1
  UNION ALL SELECT project_uuid, 'states', 'states.' || state || '.color', 'invalid_value' FROM k_states
    WHERE color NOT LIKE '#%' OR strlen(color) <> 7
  UNION ALL SELECT project_uuid, 'labels', 'labels[' || idx || '].name', 'missing_field' FROM k_labels WHERE name = ''
  UNION ALL SELECT project_uuid, 'labels', 'labels[' || idx || '].name', 'duplicate' FROM (SELECT *, row_number() OVER
    (PARTITION BY project_uuid, name ORDER BY idx) AS r FROM k_labels) WHERE r > 1
  UNION ALL SELECT project_uuid, 'workflows', 'workflows.' || workflow || '.states', 'unknown_reference' FROM k_wstates w
    WHERE NOT EXISTS (SELECT 1 FROM k_states s WHERE s.project_uuid = w.project_uuid AND s.state = w.state)
  UNION ALL SELECT project_uuid, 'workflows', 'workflows.' || workflow || '.issue_types', 'unknown_reference' FROM k_wtypes w
    WHERE NOT EXISTS (SELECT 1 FROM k_types t WHERE t.project_uuid = w.project_uuid AND t.type = w.type)
  UNION ALL SELECT project_uuid, 'workflows', 'workflows.' || workflow || '.transitions', 'unknown_reference' FROM
    (SELECT DISTINCT project_uuid, workflow, from_state FROM k_moves) m WHERE NOT EXISTS (SELECT 1 FROM k_wstates w
      WHERE w.project_uuid = m.project_uuid AND w.workflow = m.workflow AND w.state = m.from_state)
  UNION ALL SELECT project_uuid, 'workflows', 'workflows.' || workflow || '.transitions.' || from_state, 'unknown_reference'
    FROM k_moves m WHERE NOT EXISTS (SELECT 1 FROM k_wstates w
      WHERE w.project_uuid = m.project_uuid AND w.workflow = m.workflow AND w.state = m.to_state)
  UNION ALL SELECT project_uuid, 'types', 'types.' || type || '.workflow', 'unknown_reference' FROM k_types t
    WHERE NOT EXISTS (SELECT 1 FROM k_wstates w WHERE w.project_uuid = t.project_uuid AND w.workflow = t.workflow)"""


@query("v19_catalog_issues", with_parts([], CATALOG_SQL, CATALOGS))
def catalog_issues(spark, sf):
    """Integrity of state, label, workflow and type catalogs of many projects."""
    return workflow.catalog_issues(*catalogs(spark, sf))


def dated_changes(spark, sf):
    """State changes at their exact instant."""
    log = item_changes(table(spark, sf, "events"), exact=True).where(F.col("kind") == "item.set-state")
    return log.select("event_uuid", "entity_uuid", "project_uuid", "state_key", "at_us")


MOVES = {
    "moves": """SELECT c.event_uuid, c.entity_uuid, c.state_key, e.us AS at_us FROM changes c JOIN ev e
      ON e.event_id = c.stream_seq WHERE c.kind = 'item.set-state'""",
    "groups": catalog.SQL["groups"],
    "transitions": catalog.SQL["transitions"],
}


@query(
    "v20_illegal_transitions",
    with_parts(
        ["changes"],
        """SELECT event_uuid, entity_uuid, prev AS from_state, state_key AS to_state FROM (SELECT *, lag(state_key) OVER
        (PARTITION BY entity_uuid ORDER BY at_us, event_uuid) AS prev FROM moves) m
        WHERE prev IS NOT NULL AND prev <> state_key AND NOT EXISTS (SELECT 1 FROM transitions t
          WHERE t.from_state = m.prev AND t.to_state = m.state_key)""",
        MOVES,
    ),
)
def illegal_transitions(spark, sf):
    """State changes that the workflow does not allow."""
    return workflow.illegal_transitions(
        dated_changes(spark, sf), [F.col("at_us"), F.col("event_uuid")], catalog.transitions(spark)
    )


def user_edges(spark, sf):
    """Blocks and requires edges between the items of the event table."""
    users = table(spark, sf, "events").select("user_id").distinct()
    u, n = F.col("user_id"), users.agg(F.count(F.lit(1))).scalar()
    edge = lambda kind, to: users.select(
        F.lit(kind).alias("relation_kind"), tag("E", u).alias("from_uuid"), tag("E", to % n).alias("to_uuid")
    )
    return edge("blocks", u * 7 + 3).unionByName(edge("requires", u * 11 + 5))


def breach_sql(rule: str, own: str, other: str, group: str, target: str) -> str:
    return f"""SELECT '{rule}' AS rule, m.event_uuid AS entry, m.entity_uuid AS item_uuid, r.{other} AS peer_uuid,
      s.state_key AS state_then FROM moves m JOIN groups g ON g.state_key = m.state_key AND g.state_group = '{group}'
      JOIN (SELECT 'E' || user_id AS from_uuid, 'E' || ({target}) AS to_uuid FROM (SELECT DISTINCT user_id FROM events)) r
        ON r.{own} = m.entity_uuid
      LEFT JOIN LATERAL (SELECT state_key FROM moves p WHERE p.entity_uuid = r.{other} AND p.at_us <= m.at_us
        ORDER BY p.at_us DESC, p.event_uuid DESC LIMIT 1) s ON TRUE
      LEFT JOIN groups sg ON sg.state_key = s.state_key WHERE coalesce(sg.state_group, 'none') <> 'completed'"""


@query(
    "v21_rule_breaches",
    with_parts(
        ["changes"],
        breach_sql("blocks", "to_uuid", "from_uuid", "started", "(user_id * 7 + 3) % (SELECT count(DISTINCT user_id) FROM events)")
        + " UNION ALL "
        + breach_sql("requires", "from_uuid", "to_uuid", "completed", "(user_id * 11 + 5) % (SELECT count(DISTINCT user_id) FROM events)"),
        MOVES,
    ),
)
def rule_breaches(spark, sf):
    """Starts while blocked, and completions while a required item was open."""
    moves, links, groups = dated_changes(spark, sf), user_edges(spark, sf), catalog.groups(spark)
    started = workflow.rule_breaches(moves, links, groups, "blocks", "to_uuid", "from_uuid", "started")
    completed = workflow.rule_breaches(moves, links, groups, "requires", "from_uuid", "to_uuid", "completed")
    return started.unionByName(completed)


@query(
    "v22_relation_kinds",
    with_parts(
        ["edges", "items"],
        """SELECT l.relation_uuid, l.relation_kind, f.entity_kind AS from_kind, t.entity_kind AS to_kind FROM live l
        JOIN kind_of f ON f.entity_uuid = l.from_uuid JOIN kind_of t ON t.entity_uuid = l.to_uuid
        WHERE NOT EXISTS (SELECT 1 FROM relation_kinds a WHERE a.relation_kind = l.relation_kind
          AND a.from_kind = f.entity_kind AND a.to_kind = t.entity_kind)""",
        {
            **LIVE,
            "relation_kinds": catalog.SQL["relation_kinds"],
            "kind_of": """SELECT entity_uuid, CASE WHEN item_no % 5 = 0 THEN 'effort' ELSE 'issue' END AS entity_kind FROM items
              UNION ALL SELECT 'P' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'effort'
              ELSE 'issue' END FROM part""",
        },
    ),
)
def relation_kinds(spark, sf):
    """Live relations between kinds that their relation kind does not join."""
    items = order_items(spark, sf).select(
        "entity_uuid", F.when(F.col("item_no") % 5 == 0, F.lit("effort")).otherwise(F.lit("issue")).alias("entity_kind")
    )
    size = F.col("p_size") % 3
    parts = table(spark, sf, "part").select(
        tag("P", F.col("p_partkey")).alias("entity_uuid"),
        F.when(size == 0, F.lit("component")).when(size == 1, F.lit("effort")).otherwise(F.lit("issue")).alias("entity_kind"),
    )
    live = edges.live(edges.relations(edge_log(spark, sf)))
    return workflow.kind_breaches(live, items.unionByName(parts), catalog.relation_kinds(spark))

"""The given tables read as event logs, in Spark and as SQL text.

The tables hold clicks, orders and talks, not change events, so each adapter maps
one of them to the decoded log columns that the operators take. Every function has
a twin in ``SQL``: named query parts for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.skew import LIST_ITEMS

WEEK_US = 7 * 24 * 3600 * 1_000_000
HOUR_US = 3600 * 1_000_000
STATES = ("Backlog", "Todo", "In Progress", "Needs Input", "Done", "Cancelled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(value: Column) -> Column:
    return value.cast("string")


def tag(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), text(value))


def padded(value: Column) -> Column:
    return F.lpad(text(value), 26, "0")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_k(events: DataFrame) -> DataFrame:
    """Events with ``k`` from the properties, instant and week as microseconds."""
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        micros(F.col("ts")).alias("us"),
        micros(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("week_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def item_changes(events: DataFrame, exact: bool = False) -> DataFrame:
    """Work item changes, one per event row; ``exact`` adds the instant as ``at_us``."""
    i, u, k, t = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("event_type")
    node = tag("N", i % 3)
    member = F.when(k % 3 != 0, tag("l", k % 6)).otherwise(
        F.concat(F.when(k % 18 == 0, F.lit("bot:")).otherwise(F.lit("user:")), tag("m", k % 7))
    )
    shape = i % 8
    value = (
        F.when(shape == 0, F.concat(F.lit('"v'), text(k), F.lit('"')))
        .when(shape == 1, text(k))
        .when(shape == 2, F.concat(text(k), F.lit(".5")))
        .when(shape == 3, F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")))
        .when(shape == 4, F.concat(F.lit('"user:u'), text(k % 7), F.lit('"')))
        .when(
            shape == 5,
            F.concat(F.lit('"2026-01-'), F.lpad(text(k % 28 + 1), 2, "0"), F.lit('T10:00:00Z"')),
        )
        .when(
            shape == 6,
            F.when(k % 3 == 0, F.lit('"low"'))
            .when(k % 3 == 1, F.lit('"high"'))
            .otherwise(F.lit('"someday"')),
        )
        .otherwise(F.concat(F.lit('{"a":'), text(k), F.lit("}")))
    )
    rest = k % 5
    kind = (
        F.when(t == "view", F.lit("item.set-field"))
        .when(
            t == "click",
            F.when(k % 3 == 0, F.lit("item.assign-user")).otherwise(F.lit("item.add-label")),
        )
        .when(
            t == "error",
            F.when(k % 3 == 0, F.lit("item.unassign-user")).otherwise(F.lit("item.remove-label")),
        )
        .when(t == "purchase", F.lit("item.adjust-field"))
        .when(rest == 0, F.lit("item.clear-field"))
        .when(rest == 3, F.lit("item.archive"))
        .when(rest == 4, F.lit("item.restore"))
        .otherwise(F.lit("item.set-state"))
    )
    signup = t == "signup"
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), ((F.floor(k / 5) % 6) + 1).cast("int"))
    return with_k(events).select(
        padded(i).alias("event_uuid"),
        F.lit("W0").alias("workspace_uuid"),
        tag("P", u % 5).alias("project_uuid"),
        node.alias("node_uuid"),
        tag("user:u", u % 7).alias("actor"),
        tag("item:E", u).alias("stream_id"),
        i.alias("stream_seq"),
        F.col("week_us").alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        F.when(i % 4 == 0, F.lit("N0")).otherwise(node).alias("hlc_node"),
        (i % 2).alias("hlc_seq"),
        F.when(i % 11 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("schema_version"),
        (i + 1).alias("hub_offset"),
        kind.alias("kind"),
        tag("E", u).alias("entity_uuid"),
        F.when((t == "view") | (signup & (rest == 0)), tag("f", k % 4))
        .when((t == "purchase") & (k % 10 == 0), F.lit("f1"))
        .when(t == "purchase", F.lit("spend"))
        .alias("field"),
        F.when(t == "view", value).alias("value"),
        F.when(t.isin("click", "error"), member).alias("member"),
        F.when(t == "purchase", k % 21 - 10).alias("delta"),
        F.when(signup & rest.isin(1, 2), state).alias("state_key"),
        F.lit(None).cast("string").alias("entity_kind"),
        F.lit(None).cast("string").alias("item_type"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        *([F.col("us").alias("at_us")] if exact else []),
    )


def item_creates(events: DataFrame) -> DataFrame:
    """One create per user before its first event, none for every 25th user, a
    second one at the last event for every 20th."""
    u, n = F.col("user_id"), F.col("n")
    spans = (
        with_k(events)
        .groupBy("user_id")
        .agg(F.min("week_us").alias("first_us"), F.max("week_us").alias("last_us"))
        .where(u % 25 != 0)
        .withColumn("n", F.explode(F.when(u % 20 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    )
    entity_kind = (
        F.when(u % 9 == 0, F.lit("effort")).when(u % 9 == 1, F.lit("component")).otherwise(F.lit("issue"))
    )
    item_type = (
        F.when((n == 0) & (u % 8 == 0), F.lit(None))
        .when((n == 0) & (u % 8 == 1), F.lit("ghost"))
        .when(u % 9 == 0, F.lit("sprint"))
        .when(u % 9 == 1, F.lit("module"))
        .when(u % 2 == 1, F.lit("bug"))
        .otherwise(F.lit("task"))
    )
    title = F.concat(F.lit('"Item '), text(u), F.lit('"'))
    f0 = F.when(n == 0, F.lit('"init"')).otherwise(F.lit('"again"'))
    fields = F.when(u % 10 == 3, F.create_map(F.lit("f0"), f0)).otherwise(
        F.create_map(F.lit("title"), title, F.lit("f0"), f0)
    )
    none = F.lit(None).cast("string")
    return spans.select(
        F.concat(F.lit("C"), text(n), F.lpad(text(u), 24, "0")).alias("event_uuid"),
        F.lit("W0").alias("workspace_uuid"),
        tag("P", u % 5).alias("project_uuid"),
        F.lit("N1").alias("node_uuid"),
        tag("user:u", u % 7).alias("actor"),
        tag("item:E", u).alias("stream_id"),
        n.cast("bigint").alias("stream_seq"),
        F.when(n == 0, F.col("first_us") - WEEK_US).otherwise(F.col("last_us")).alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        F.lit("N0").alias("hlc_node"),
        F.lit(0).cast("bigint").alias("hlc_seq"),
        F.lit(1).cast("bigint").alias("schema_version"),
        F.lit(None).cast("bigint").alias("hub_offset"),
        F.lit("item.create").alias("kind"),
        tag("E", u).alias("entity_uuid"),
        none.alias("field"),
        none.alias("value"),
        none.alias("member"),
        F.lit(None).cast("bigint").alias("delta"),
        none.alias("state_key"),
        entity_kind.alias("entity_kind"),
        item_type.alias("item_type"),
        fields.alias("fields"),
    )


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return item_changes(events).unionByName(item_creates(events))


def claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, progress notes and releases on items, one per event row of any type."""
    i, u, k, t = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("event_type")
    agent = tag("agent:x", k % 4)
    claims = (t == "view") | ((t == "purchase") & (k % 3 == 0))
    return with_k(table(spark, sf_dir, "events")).select(
        padded(i).alias("event_uuid"),
        tag("P", u % 5).alias("project_uuid"),
        tag("N", i % 3).alias("node_uuid"),
        agent.alias("actor"),
        i.alias("stream_seq"),
        F.col("us").alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        tag("N", i % 3).alias("hlc_node"),
        (i % 2).alias("hlc_seq"),
        F.when(claims, F.lit("execution.claim"))
        .when(t.isin("click", "signup"), F.lit("execution.progress"))
        .otherwise(F.lit("execution.release"))
        .alias("kind"),
        tag("E", u).alias("entity_uuid"),
        F.when(claims, agent).alias("executor"),
        F.when(claims, F.col("us") + (k + 1) * HOUR_US).alias("expires_us"),
    )


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation changes, one per line item."""
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in ("blocks", "requires", "extends", "duplicates", "parent")])
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", o, line, p, s, qty).alias("event_uuid"),
        tag("P", o % 5).alias("project_uuid"),
        tag("N", s % 3).alias("node_uuid"),
        p.alias("stream_seq"),
        micros(F.col("l_shipdate")).alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        tag("N", s % 3).alias("hlc_node"),
        qty.alias("hlc_seq"),
        F.when(flag == "N", F.lit("relation.create"))
        .when(flag == "A", F.lit("relation.set-attr"))
        .otherwise(F.lit("relation.delete"))
        .alias("kind"),
        F.concat(F.lit("R"), text(o), F.lit("-"), text(line)).alias("relation_uuid"),
        F.when(flag == "N", F.element_at(kinds, (p % 5 + 1).cast("int"))).alias("relation_kind"),
        F.when(flag == "N", tag("O", o)).alias("from_uuid"),
        F.when(flag == "N", tag("P", p)).alias("to_uuid"),
        F.when(flag == "N", F.create_map(F.lit("qty"), text(qty)))
        .when(flag == "A", F.create_map(F.lit("qty"), text(qty), tag("s", s % 3), text(s)))
        .alias("attrs"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: one row per item with state, project and effort."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        tag("O", F.col("o_orderkey")).alias("entity_uuid"),
        tag("P", F.col("o_custkey") % 5).alias("project_uuid"),
        tag("C", F.col("o_custkey")).alias("effort_uuid"),
        F.when(status == "F", F.lit("Done"))
        .when(status == "P", F.lit("In Progress"))
        .otherwise(F.lit("Todo"))
        .alias("state_key"),
        F.col("o_orderpriority").alias("priority"),
        micros(F.col("o_orderdate")).alias("created_us"),
        F.col("o_orderkey").alias("item_no"),
    )


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-to-item edges: ``blocks`` for orders with such a first line, else ``requires``."""
    orders = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    blocks = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)
    kind = F.when(blocks, F.lit("blocks")).otherwise(F.lit("requires"))
    first = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("relation_kind")).distinct()
    o = F.col("l_orderkey")
    return first.select(
        "relation_kind",
        tag("O", o).alias("from_uuid"),
        tag("O", (o * 7 + 3) % orders.scalar()).alias("to_uuid"),
    )


def talk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment changes, one per conversation turn."""
    c, n = F.col("conv_id"), F.col("turn")
    edit, delete = n % 5 == 4, n % 7 == 6
    target = F.when(edit | delete, n - 1).otherwise(n)
    kind = (
        F.when(edit, F.lit("comment.edit")).when(delete, F.lit("comment.delete")).otherwise(F.lit("comment.add"))
    )
    add = ~(edit | delete)
    ask = add & (n % 4 == 1)
    comment = lambda turn: F.concat(F.lit("M"), text(c), F.lit("-"), text(turn))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("T"), text(c), F.lit("-"), text(n)).alias("event_uuid"),
        tag("N", c % 3).alias("node_uuid"),
        n.alias("stream_seq"),
        (n * 1_000_000).alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        tag("N", c % 3).alias("hlc_node"),
        F.lit(0).cast("bigint").alias("hlc_seq"),
        kind.alias("kind"),
        comment(target).alias("comment_uuid"),
        tag("V", c).alias("entity_uuid"),
        F.when(add, F.when(F.col("role") == "user", F.lit("user:human")).otherwise(tag("agent:", F.col("role")))).alias("author"),
        F.when(~delete | edit, F.col("text")).alias("body"),
        F.when(ask, F.lit("needs_input")).alias("comment_kind"),
        F.when(ask, tag("user:u", c % 7)).alias("directed_at"),
        F.when(add & (n % 3 == 2), comment(n - 1)).alias("replaces"),
    )


def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema migrations, one per order, of forty projects."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    slot = (o % 16).cast("int")
    kinds = [
        "schema.init",
        "schema.snapshot",
        "schema.remove-field",
        "schema.rename-field",
        "schema.change-field-type",
        "schema.add-item-type",
        "schema.add-enum-value",
        "schema.rename-enum-value",
        "schema.add-relation-kind",
        "schema.set-compatibility",
    ]
    kind = F.coalesce(
        F.get(F.array(*[F.lit(x) for x in kinds]), slot), F.lit("schema.add-field")
    )
    entity = F.element_at(F.array(*[F.lit(x) for x in ("issue", "effort", "component")]), (o % 3 + 1).cast("int"))
    body = F.concat(
        F.lit('{"types":{"bug":{"entity_kind":"issue","fields":{"title":{"kind":"text","required":true},"c'),
        text(c % 20),
        F.lit('":{"kind":"number","required":false}}},"t'),
        text(o % 3),
        F.lit('":{"entity_kind":"'),
        entity,
        F.lit('","fields":{"note":{"kind":"url","required":false}}}}}'),
    )
    word = F.element_at(F.array(*[F.lit(x) for x in ("text", "number", "decimal", "boolean")]), (o % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        padded(o).alias("event_uuid"),
        tag("S", c % 40).alias("project_uuid"),
        tag("N", o % 3).alias("node_uuid"),
        o.alias("stream_seq"),
        micros(F.col("o_orderdate")).alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        tag("N", o % 3).alias("hlc_node"),
        (o % 2).alias("hlc_seq"),
        kind.alias("kind"),
        F.when(slot == 1, o % 100).alias("given_version"),
        F.when(slot < 2, body).alias("body"),
        entity.alias("entity_kind"),
        tag("c", c % 20).alias("field"),
        tag("c", (c + 1) % 20).alias("new_field"),
        word.alias("field_kind"),
        (o % 2 == 0).alias("required"),
        tag("t", o % 3).alias("type_name"),
        tag("e", c % 3).alias("enum_name"),
        tag("v", o % 7).alias("enum_value"),
        tag("v", (o + 2) % 7).alias("new_value"),
        tag("r", c % 5).alias("relation_kind"),
        F.element_at(F.array(*[F.lit(x) for x in ("strict", "additive", "permissive")]), (o % 3 + 1).cast("int")).alias("policy"),
    )


# --- the same adapters as SQL parts -----------------------------------------

ORDER_SQL = "hlc_us, hlc_ns, hlc_node, hlc_seq, node_uuid, stream_seq, event_uuid"
DESC_SQL = ", ".join(c.strip() + " DESC" for c in ORDER_SQL.split(","))

SQL = {}
SQL["ev"] = """SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
  epoch_us(date_trunc('week', ts)) AS week_us,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
SQL["changes"] = """SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid,
  'W0' AS workspace_uuid, 'P' || (user_id % 5) AS project_uuid, 'N' || (event_id % 3) AS node_uuid,
  'user:u' || (user_id % 7) AS actor, 'item:E' || user_id AS stream_id, event_id AS stream_seq,
  week_us AS hlc_us, 0 AS hlc_ns,
  CASE WHEN event_id % 4 = 0 THEN 'N0' ELSE 'N' || (event_id % 3) END AS hlc_node,
  event_id % 2 AS hlc_seq,
  CAST(CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS schema_version,
  event_id + 1 AS hub_offset,
  CASE event_type WHEN 'view' THEN 'item.set-field'
    WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'item.assign-user' ELSE 'item.add-label' END
    WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'item.unassign-user' ELSE 'item.remove-label' END
    WHEN 'purchase' THEN 'item.adjust-field'
    ELSE CASE k % 5 WHEN 0 THEN 'item.clear-field' WHEN 3 THEN 'item.archive'
      WHEN 4 THEN 'item.restore' ELSE 'item.set-state' END END AS kind,
  'E' || user_id AS entity_uuid,
  CASE WHEN event_type = 'view' OR (event_type = 'signup' AND k % 5 = 0) THEN 'f' || (k % 4)
    WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'f1'
    WHEN event_type = 'purchase' THEN 'spend' END AS field,
  CASE WHEN event_type = 'view' THEN CASE event_id % 8
    WHEN 0 THEN '"v' || k || '"' WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN k || '.5'
    WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
    WHEN 4 THEN '"user:u' || (k % 7) || '"'
    WHEN 5 THEN '"2026-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z"'
    WHEN 6 THEN CASE k % 3 WHEN 0 THEN '"low"' WHEN 1 THEN '"high"' ELSE '"someday"' END
    ELSE '{"a":' || k || '}' END END AS value,
  CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN k % 3 <> 0 THEN 'l' || (k % 6)
    WHEN k % 18 = 0 THEN 'bot:m' || (k % 7) ELSE 'user:m' || (k % 7) END END AS member,
  CASE WHEN event_type = 'purchase' THEN k % 21 - 10 END AS delta,
  CASE WHEN event_type = 'signup' AND k % 5 IN (1, 2) THEN
    (['Backlog', 'Todo', 'In Progress', 'Needs Input', 'Done', 'Cancelled'])[(k // 5) % 6 + 1]
    END AS state_key,
  CAST(NULL AS VARCHAR) AS entity_kind, CAST(NULL AS VARCHAR) AS item_type,
  CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS f0 FROM ev"""
SQL["creates"] = """SELECT 'C' || n || lpad(CAST(user_id AS VARCHAR), 24, '0') AS event_uuid,
  'W0' AS workspace_uuid, 'P' || (user_id % 5) AS project_uuid, 'N1' AS node_uuid,
  'user:u' || (user_id % 7) AS actor, 'item:E' || user_id AS stream_id,
  CAST(n AS BIGINT) AS stream_seq,
  CASE n WHEN 0 THEN first_us - 604800000000 ELSE last_us END AS hlc_us, 0 AS hlc_ns,
  'N0' AS hlc_node, CAST(0 AS BIGINT) AS hlc_seq, CAST(1 AS BIGINT) AS schema_version,
  CAST(NULL AS BIGINT) AS hub_offset, 'item.create' AS kind, 'E' || user_id AS entity_uuid,
  NULL AS field, NULL AS value, NULL AS member, NULL AS delta, NULL AS state_key,
  CASE user_id % 9 WHEN 0 THEN 'effort' WHEN 1 THEN 'component' ELSE 'issue' END AS entity_kind,
  CASE WHEN n = 0 AND user_id % 8 = 0 THEN NULL WHEN n = 0 AND user_id % 8 = 1 THEN 'ghost'
    WHEN user_id % 9 = 0 THEN 'sprint' WHEN user_id % 9 = 1 THEN 'module'
    WHEN user_id % 2 = 1 THEN 'bug' ELSE 'task' END AS item_type,
  CASE WHEN user_id % 10 <> 3 THEN '"Item ' || user_id || '"' END AS title,
  CASE n WHEN 0 THEN '"init"' ELSE '"again"' END AS f0
  FROM (SELECT user_id, min(week_us) AS first_us, max(week_us) AS last_us FROM ev GROUP BY user_id),
       (VALUES (0), (1)) v(n)
  WHERE user_id % 25 <> 0 AND (n = 0 OR user_id % 20 = 7)"""
SQL["log"] = "SELECT * FROM changes UNION ALL SELECT * FROM creates"
SQL["writes"] = """SELECT *, 'field' AS reg, field AS name, value AS written FROM log
    WHERE kind IN ('item.set-field', 'item.clear-field')
  UNION ALL SELECT *, 'field', 'title', title FROM log WHERE kind = 'item.create' AND title IS NOT NULL
  UNION ALL SELECT *, 'field', 'f0', f0 FROM log WHERE kind = 'item.create'"""
SQL["claims"] = """SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_uuid,
  'P' || (user_id % 5) AS project_uuid, 'N' || (event_id % 3) AS node_uuid,
  'agent:x' || (k % 4) AS actor, event_id AS stream_seq, us AS hlc_us, 0 AS hlc_ns,
  'N' || (event_id % 3) AS hlc_node, event_id % 2 AS hlc_seq,
  CASE WHEN claims THEN 'execution.claim' WHEN event_type IN ('click', 'signup') THEN 'execution.progress'
    ELSE 'execution.release' END AS kind, 'E' || user_id AS entity_uuid,
  CASE WHEN claims THEN 'agent:x' || (k % 4) END AS executor,
  CASE WHEN claims THEN us + (k + 1) * 3600000000 END AS expires_us
  FROM (SELECT *, event_type = 'view' OR (event_type = 'purchase' AND k % 3 = 0) AS claims FROM ev)"""
SQL["edges"] = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(l_quantity AS BIGINT)) AS event_uuid,
  'P' || (l_orderkey % 5) AS project_uuid, 'N' || (l_suppkey % 3) AS node_uuid,
  l_partkey AS stream_seq, epoch_us(l_shipdate) AS hlc_us, 0 AS hlc_ns,
  'N' || (l_suppkey % 3) AS hlc_node, CAST(l_quantity AS BIGINT) AS hlc_seq,
  CASE l_returnflag WHEN 'N' THEN 'relation.create' WHEN 'A' THEN 'relation.set-attr'
    ELSE 'relation.delete' END AS kind,
  'R' || l_orderkey || '-' || l_linenumber AS relation_uuid,
  CASE WHEN l_returnflag = 'N' THEN
    (['blocks', 'requires', 'extends', 'duplicates', 'parent'])[l_partkey % 5 + 1] END AS relation_kind,
  CASE WHEN l_returnflag = 'N' THEN 'O' || l_orderkey END AS from_uuid,
  CASE WHEN l_returnflag = 'N' THEN 'P' || l_partkey END AS to_uuid,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty, l_suppkey AS supp FROM lineitem"""
SQL["items"] = """SELECT 'O' || o_orderkey AS entity_uuid, 'P' || (o_custkey % 5) AS project_uuid,
  'C' || o_custkey AS effort_uuid, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'In Progress'
  ELSE 'Todo' END AS state_key, o_orderpriority AS priority, epoch_us(o_orderdate) AS created_us,
  o_orderkey AS item_no FROM orders"""
SQL["links"] = """SELECT DISTINCT CASE WHEN l_returnflag = 'N' AND l_linenumber = 1
  THEN 'blocks' ELSE 'requires' END AS relation_kind, 'O' || l_orderkey AS from_uuid,
  'O' || ((l_orderkey * 7 + 3) % (SELECT count(*) FROM orders)) AS to_uuid
  FROM lineitem"""
SQL["talks"] = """SELECT 'T' || conv_id || '-' || turn AS event_uuid, 'N' || (conv_id % 3) AS node_uuid,
  turn AS stream_seq, turn * 1000000 AS hlc_us, 0 AS hlc_ns, 'N' || (conv_id % 3) AS hlc_node,
  CAST(0 AS BIGINT) AS hlc_seq,
  CASE WHEN turn % 5 = 4 THEN 'comment.edit' WHEN turn % 7 = 6 THEN 'comment.delete'
    ELSE 'comment.add' END AS kind,
  'M' || conv_id || '-' || CASE WHEN turn % 5 = 4 OR turn % 7 = 6 THEN turn - 1 ELSE turn END AS comment_uuid,
  'V' || conv_id AS entity_uuid,
  CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN
    CASE WHEN role = 'user' THEN 'user:human' ELSE 'agent:' || role END END AS author,
  CASE WHEN turn % 7 <> 6 OR turn % 5 = 4 THEN text END AS body,
  CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 AND turn % 4 = 1 THEN 'needs_input' END AS comment_kind,
  CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 AND turn % 4 = 1 THEN 'user:u' || (conv_id % 7) END AS directed_at,
  CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 AND turn % 3 = 2 THEN 'M' || conv_id || '-' || (turn - 1) END AS replaces
  FROM conversations"""
SQL["schema_log"] = """SELECT lpad(CAST(o_orderkey AS VARCHAR), 26, '0') AS event_uuid,
  'S' || (o_custkey % 40) AS project_uuid, 'N' || (o_orderkey % 3) AS node_uuid,
  o_orderkey AS stream_seq, epoch_us(o_orderdate) AS hlc_us, 0 AS hlc_ns,
  'N' || (o_orderkey % 3) AS hlc_node, o_orderkey % 2 AS hlc_seq,
  coalesce((['schema.init', 'schema.snapshot', 'schema.remove-field', 'schema.rename-field',
    'schema.change-field-type', 'schema.add-item-type', 'schema.add-enum-value',
    'schema.rename-enum-value', 'schema.add-relation-kind', 'schema.set-compatibility'])[o_orderkey % 16 + 1],
    'schema.add-field') AS kind,
  CASE WHEN o_orderkey % 16 = 1 THEN o_orderkey % 100 END AS given_version,
  (['issue', 'effort', 'component'])[o_orderkey % 3 + 1] AS entity_kind,
  'c' || (o_custkey % 20) AS field, 'c' || ((o_custkey + 1) % 20) AS new_field,
  (['text', 'number', 'decimal', 'boolean'])[o_orderkey % 4 + 1] AS field_kind,
  o_orderkey % 2 = 0 AS required, 't' || (o_orderkey % 3) AS type_name, 'e' || (o_custkey % 3) AS enum_name,
  'v' || (o_orderkey % 7) AS enum_value, 'v' || ((o_orderkey + 2) % 7) AS new_value,
  'r' || (o_custkey % 5) AS relation_kind,
  (['strict', 'additive', 'permissive'])[o_orderkey % 3 + 1] AS policy FROM orders"""

NEEDS = {
    "changes": ["ev"],
    "creates": ["ev"],
    "log": ["changes", "creates"],
    "writes": ["log"],
    "claims": ["ev"],
}


def parted(source: str, keys: str, item: str) -> str:
    """The rows of a source with the part of the sorted list of ``item`` that they are in."""
    place = f"row_number() OVER (PARTITION BY {keys} ORDER BY {item})"
    return f"(SELECT *, CAST(({place} - 1) // {LIST_ITEMS} AS INTEGER) AS part FROM {source})"


def with_parts(parts: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A query text with the named parts (and what they need) in front.

    ``body`` may use ``{o}`` and ``{desc}`` for the canonical order.
    """
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        seen.setdefault(name, SQL[name])

    for part in parts:
        add(part)
    seen.update(extra or {})
    fill = lambda q: q.replace("{o}", ORDER_SQL).replace("{desc}", DESC_SQL)
    head = ", ".join(f"{name} AS ({fill(q)})" for name, q in seen.items())
    return f"WITH {head} {fill(body)}" if head else fill(body)

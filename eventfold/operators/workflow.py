"""Catalog integrity, state changes against transitions, relation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.operators.skew import last_known, ordered, previous_row


def issue(rows: DataFrame, file: str, path: Column, code: str) -> DataFrame:
    return rows.select(
        "project_uuid", F.lit(file).alias("file"), path.alias("path"), F.lit(code).alias("code")
    )


def state_issues(projects: DataFrame, states: DataFrame) -> DataFrame:
    """At least one state, exactly one default, colours as ``#`` and six digits."""
    per = states.groupBy("project_uuid").agg(
        F.sum(F.col("is_default").cast("bigint")).alias("defaults")
    )
    color = ~F.col("color").startswith("#") | (F.octet_length("color") != 7)
    return (
        issue(
            projects.join(per, "project_uuid", "left_anti"), "states", F.lit("states"), "missing_field"
        )
        .unionByName(issue(per.where("defaults <> 1"), "states", F.lit("states"), "invariant"))
        .unionByName(
            issue(
                states.where(color), "states", F.concat(F.lit("states."), "state", F.lit(".color")), "invalid_value"
            )
        )
    )


def label_issues(labels: DataFrame) -> DataFrame:
    """Empty names, and every later use of a name in the same project."""
    path = F.concat(F.lit("labels["), F.col("idx").cast("string"), F.lit("].name"))
    first = labels.groupBy("project_uuid", "name").agg(F.min("idx").alias("first"))
    again = labels.join(first, ["project_uuid", "name"], "inner").where("idx > first")
    return issue(labels.where("name = ''"), "labels", path, "missing_field").unionByName(
        issue(again, "labels", path, "duplicate")
    )


def reference_issues(
    file: str, rows: DataFrame, keys: list[str], known: DataFrame, path: Column
) -> DataFrame:
    """Rows whose ``keys`` name nothing in ``known``."""
    missing = rows.join(known.select(*keys).distinct(), keys, "left_anti")
    return issue(missing, file, path, "unknown_reference")


def catalog_issues(
    projects: DataFrame,
    states: DataFrame,
    labels: DataFrame,
    workflow_states: DataFrame,
    workflow_types: DataFrame,
    transitions: DataFrame,
    types: DataFrame,
) -> DataFrame:
    """All integrity findings over the catalogs of many projects."""
    wf = lambda tail: F.concat_ws(".", F.lit("workflows"), "workflow", F.lit(tail))
    inside = ["project_uuid", "workflow", "state"]
    as_state = lambda end: transitions.withColumn("state", F.col(end))
    workflows = workflow_states.select("project_uuid", "workflow").distinct()
    out = state_issues(projects, states).unionByName(label_issues(labels))
    for rows in (
        reference_issues("workflows", workflow_states, ["project_uuid", "state"], states, wf("states")),
        reference_issues("workflows", workflow_types, ["project_uuid", "type"], types, wf("issue_types")),
        reference_issues("workflows", as_state("from_state").select(*inside).distinct(), inside, workflow_states, wf("transitions")),
        reference_issues(
            "workflows",
            as_state("to_state"),
            inside,
            workflow_states,
            F.concat_ws(".", F.lit("workflows"), "workflow", F.lit("transitions"), "from_state"),
        ),
        reference_issues("types", types, ["project_uuid", "workflow"], workflows, F.concat_ws(".", F.lit("types"), "type", F.lit("workflow"))),
    ):
        out = out.unionByName(rows)
    return out


def state_changes(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == "item.set-state")


def illegal_transitions(
    changes: DataFrame, order: list[Column], transitions: DataFrame, rows_per_split: int | None = None
) -> DataFrame:
    """State changes of an item that no transition allows; staying is allowed."""
    rows = ordered(
        changes,
        ["entity_uuid"],
        order,
        {"prev": previous_row(F.struct("state_key"), order)},
        rows_per_split,
    )
    moves = rows.select(
        "event_uuid",
        "entity_uuid",
        F.col("prev.state_key").alias("from_state"),
        F.col("state_key").alias("to_state"),
    ).where("from_state is not null and from_state <> to_state")
    return moves.join(transitions, ["from_state", "to_state"], "left_anti")


def state_at(probes: DataFrame, changes: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """As-of lookup: the state of ``entity_uuid`` at ``at_us`` for each probe.

    Probes and changes are one ordered stream per entity; a change at the very same
    instant counts as before the probe. Probe columns are kept.
    """
    keep = [c for c in probes.columns if c not in ("entity_uuid", "at_us")]
    asked = probes.select(
        "entity_uuid", "at_us", F.lit(1).alias("__side"), F.struct(*keep).alias("__probe"), F.lit(None).cast("string").alias("__state")
    )
    known = changes.select(
        "entity_uuid", "at_us", F.lit(0).alias("__side"), F.lit(None).alias("__probe"), F.col("state_key").alias("__state"), F.col("event_uuid").alias("__id")
    )
    rows = known.unionByName(asked.withColumn("__id", F.to_json("__probe")))
    order = [F.col("at_us"), F.col("__side"), F.col("__id")]
    seen = ordered(
        rows, ["entity_uuid"], order, {"state_then": last_known(F.col("__state"), order)}, rows_per_split
    ).where("__side = 1")
    return seen.select("entity_uuid", "at_us", "__probe.*", "state_then")


def rule_breaches(
    changes: DataFrame,
    edges: DataFrame,
    groups: DataFrame,
    relation_kind: str,
    own_end: str,
    other_end: str,
    entering: str,
    rows_per_split: int | None = None,
) -> DataFrame:
    """Entries into a state group while a related item was not completed.

    ``blocks``: an item starts, the source of an incoming edge is not completed.
    ``requires``: an item completes, the target of an outgoing edge is not.
    """
    grouped = changes.join(groups, "state_key")
    entries = grouped.where(F.col("state_group") == entering).select(
        F.col("entity_uuid").alias(own_end), "at_us", F.col("event_uuid").alias("entry")
    )
    pairs = entries.join(
        edges.where(F.col("relation_kind") == relation_kind).select("from_uuid", "to_uuid"), own_end
    )
    probes = pairs.select(
        F.col(other_end).alias("entity_uuid"), "at_us", "entry", F.col(own_end).alias("item_uuid")
    )
    seen = state_at(probes, changes, rows_per_split).join(
        groups.withColumnRenamed("state_key", "state_then"), "state_then", "left"
    )
    open_ = F.col("state_group").isNull() | (F.col("state_group") != "completed")
    return seen.where(open_).select(
        F.lit(relation_kind).alias("rule"), "entry", "item_uuid", F.col("entity_uuid").alias("peer_uuid"), "state_then"
    )


def kind_breaches(relations: DataFrame, kinds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Live relations whose ends are of kinds that their relation kind does not join."""
    side = lambda end, name: kinds.select(
        F.col("entity_uuid").alias(end), F.col("entity_kind").alias(name)
    )
    rows = relations.select("relation_uuid", "relation_kind", "from_uuid", "to_uuid").join(side("from_uuid", "from_kind"), ["from_uuid"], "inner")
    rows = rows.join(side("to_uuid", "to_kind"), ["to_uuid"], "inner")
    return rows.join(allowed, ["relation_kind", "from_kind", "to_kind"], "left_anti").select(
        "relation_uuid", "relation_kind", "from_kind", "to_kind"
    )

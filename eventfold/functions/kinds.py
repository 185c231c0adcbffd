"""Event kinds and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed list of event kinds on the wire.
SCHEMA_KINDS = (
    "schema.init",
    "schema.add-item-type",
    "schema.add-field",
    "schema.remove-field",
    "schema.rename-field",
    "schema.change-field-type",
    "schema.add-enum-value",
    "schema.rename-enum-value",
    "schema.add-relation-kind",
    "schema.set-compatibility",
    "schema.snapshot",
)
WORK_KINDS = (
    "item.create",
    "item.set-field",
    "item.adjust-field",
    "item.clear-field",
    "item.add-label",
    "item.remove-label",
    "item.assign-user",
    "item.unassign-user",
    "item.set-state",
    "item.allocate-number",
    "item.archive",
    "item.restore",
    "comment.add",
    "comment.edit",
    "comment.delete",
    "relation.create",
    "relation.set-attr",
    "relation.delete",
    "execution.claim",
    "execution.progress",
    "execution.release",
    "blob.add",
    "blob.link",
    "blob.unlink",
)
NODE_KINDS = ("node.register",)
ALL_KINDS = SCHEMA_KINDS + WORK_KINDS + NODE_KINDS


def event_class(kind: Column) -> Column:
    """``schema``, ``work`` or ``node``; NULL for an unknown kind."""
    return (
        F.when(kind.isin(*SCHEMA_KINDS), F.lit("schema"))
        .when(kind.isin(*WORK_KINDS), F.lit("work"))
        .when(kind.isin(*NODE_KINDS), F.lit("node"))
    )

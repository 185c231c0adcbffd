"""The short way in: a log to its state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventfold.operators import edges, leases, registers, replay, sets, snapshots, threads
from eventfold.streaming.reduction import start_gate, start_pull, start_reduction, state

__all__ = ["ingest_and_reduce", "reduce_log", "start_gate", "start_pull", "start_reduction", "state"]

PARTS = {
    "comments": ("author", threads.comments),
    "relations": ("attrs", edges.relations),
    "claims": ("executor", leases.last_claims),
}


def ingest_and_reduce(log: DataFrame, arrival: str | None = None) -> dict[str, DataFrame]:
    """Copies out, gate, typed writes, merge, validation and one outcome an event.

    ``log`` is decoded (see ``sources.jsonlines.flat_log``) and may hold copies, told
    apart by ``arrival``. Returns ``fields`` (typed registers), ``outcomes``, ``errors``,
    ``conflicts`` (a row a finding of a failing event), ``schema_fields`` in force, and the
    parts of ``tables``, all from accepted events only.
    """
    if arrival is None:
        log, arrival = log.dropDuplicates(["event_uuid"]), "hlc_us"
    done = replay.replay(log)
    outcomes = replay.outcomes(done, arrival)
    out = tables(done.accepted.select(*[c for c in log.columns if c in done.accepted.columns]))
    return out | {
        "fields": replay.state(done),
        "outcomes": outcomes,
        "errors": outcomes.where("error is not null"),
        "conflicts": replay.conflict_rows(done),
        "revalidations": replay.revalidations(done),
        "schema_fields": replay.schema_time.in_force(done.schema.fields),
    }


reduce_log = ingest_and_reduce


def tables(log: DataFrame) -> dict[str, DataFrame]:
    """State tables of a log whose events all count, each once; fields stay untyped.
    Parts whose columns the log lacks are left out."""
    out = snapshots.take(log) if {"member", "delta"} <= set(log.columns) else {}
    if "state_key" in log.columns:
        out["headers"] = registers.headers(log)
    if "sets" in out:
        out["members"] = sets.active_members(out["sets"])
    for name, (needs, reduce_part) in PARTS.items():
        if needs in log.columns:
            out[name] = reduce_part(log)
    if "relations" in out:
        out["attributes"] = edges.attributes(log, out["relations"])
    return out

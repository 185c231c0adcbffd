"""Registers, sets and counters on hand-checked logs."""

import random

from pyspark.sql import functions as F

from eventfold.operators import changes, registers, sets
from eventfold.operators.order import first_copy
from tests.logs import create, event, frame


def values(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def set_field(n, at, value, node="N0", field="priority"):
    return event(n, "item.set-field", at, node=node, field=field, value=value)


def state_of(spark, rows):
    return values(registers.field_state(frame(spark, rows)), "entity_uuid", "field", "value")


def test_later_stamp_wins_whatever_the_arrival(spark):
    rows = [set_field(1, 22, '"low"'), set_field(2, 62, '"urgent"', "N1")]
    assert state_of(spark, rows) == {("E1", "priority"): '"urgent"'}
    assert state_of(spark, rows[::-1]) == {("E1", "priority"): '"urgent"'}


def test_equal_stamp_greater_node_wins(spark):
    rows = [set_field(1, 5, '"low"', "N0"), set_field(2, 5, '"high"', "N1")]
    assert state_of(spark, rows) == {("E1", "priority"): '"high"'}


def test_clear_keeps_a_tombstone_with_provenance(spark):
    rows = [create(1, 1, title='"A"'), event(2, "item.clear-field", 2, field="title")]
    row = registers.field_state(frame(spark, rows)).collect()[0]
    assert (row.value, row.value_type, row.stream_seq) == (None, "cleared", 2)
    older = rows + [event(3, "item.set-field", 1, node="A", field="title", value='"late"')]
    assert registers.field_state(frame(spark, older)).collect()[0].value is None


def test_header_keeps_created_and_ignores_labels(spark):
    rows = [
        create(1, 10),
        event(2, "item.set-state", 20, state_key="Todo"),
        event(3, "item.archive", 30),
        event(4, "item.add-label", 99, member="x"),
        create(5, 15, item_type="task"),
    ]
    row = registers.headers(frame(spark, rows)).collect()[0]
    assert (row.created_us, row.updated_us) == (10, 30)
    assert (row.item_type, row.state_key, row.archived) == ("task", "Todo", True)


def test_or_set(spark):
    add = lambda n, at: event(n, "item.add-label", at, member="red")
    remove = lambda n, at: event(n, "item.remove-label", at, member="red")
    active = lambda rows: [
        r.active for r in sets.or_set(sets.set_operations(frame(spark, rows))).collect()
    ]
    assert active([add(1, 1), remove(2, 2)]) == [False]
    assert active([add(1, 2), remove(2, 1)]) == [True]


def test_counter_ignores_copies(spark):
    five, three = [event(n, "item.adjust-field", n, field="c", delta=d) for n, d in ((1, 5), (2, 3))]
    row = sets.counters(sets.adjustments(frame(spark, [five, three, three]))).collect()[0]
    assert (row.total, row.adjustments) == (8, 2)


def test_history_and_as_of(spark):
    rows = [set_field(n, n * 10, f'"{n}"') for n in (1, 2, 3)]
    log = frame(spark, rows)
    for limit in (None, 1):
        got = sorted(registers.field_history(log, limit).collect(), key=lambda r: r.version)
        assert [(r.version, r.valid_from_us, r.valid_to_us) for r in got] == [(1, 10, 20), (2, 20, 30), (3, 30, None)]
    assert state_of(spark, rows[:2]) == values(
        registers.field_state(registers.as_of(log, 25)), "entity_uuid", "field", "value"
    )


def random_log(seed, size=200):
    pick = random.Random(seed)
    rows = []
    for n in range(size):
        entity, at = f"E{pick.randrange(4)}", pick.randrange(30)
        kind = pick.choice(
            ["item.set-field", "item.clear-field", "item.add-label", "item.remove-label", "item.adjust-field", "item.set-state"]
        )
        rows.append(
            event(
                n, kind, at, node=f"N{pick.randrange(3)}", entity=entity,
                field=f"f{pick.randrange(2)}" if "field" in kind else None,
                value=f'"{n}"' if kind == "item.set-field" else None,
                member=f"m{pick.randrange(2)}" if "label" in kind else None,
                delta=pick.randrange(-5, 6) if "adjust" in kind else None,
                state_key=f"s{n}" if kind == "item.set-state" else None,
            )
        )
    return rows


def test_batches_in_any_order_equal_one_reduction(spark):
    rows = random_log(7)
    whole = {tuple(r) for r in changes.reduce_log(frame(spark, rows)).collect()}
    pick = random.Random(3)
    sent = rows + pick.sample(rows, 60)
    pick.shuffle(sent)
    once = first_copy(frame(spark, sent))
    part = F.pmod(F.xxhash64("event_uuid"), F.lit(3))
    state = changes.reduce_log(once.where(part == 2))
    for k in (0, 1):
        state = changes.merge(state, changes.reduce_log(once.where(part == k)))
    assert {tuple(r) for r in state.collect()} == whole

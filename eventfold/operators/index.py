"""Index queries over reduced state.

``items`` has one row per item: ``entity_uuid``, ``project_uuid``, ``state_key`` and
more; ``groups`` maps states to semantic groups; ``edges`` are live relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.stamps import ULID
from eventfold.functions.values import URN_SCHEME
from eventfold.operators.loops import components
from eventfold.operators.skew import LIST_ITEMS, following_row, list_parts, ordered, position, previous_row, running_sum

DAY_US = 24 * 3600 * 1_000_000
# Semantic groups, and the ones that close an item.
GROUPS = ("backlog", "unstarted", "started", "completed", "cancelled")
CLOSED = ("completed", "cancelled")
# Names of relation kinds seen from their target.
INVERSE = {
    "blocks": "blocked_by",
    "requires": "required_by",
    "extends": "extended_by",
    "duplicates": "duplicated_by",
    "parent": "child",
}


def item_list(
    items: DataFrame,
    members: DataFrame,
    claims: DataFrame,
    state: str | None = None,
    label: str | None = None,
    effort: str | None = None,
    executor: str | None = None,
    unclaimed: bool = False,
    archived: bool | None = False,
) -> DataFrame:
    """Items under the given filters; ``claims`` are the active ones."""
    out = items
    if archived is not None:
        out = out.where(F.col("archived") == archived)
    if state is not None:
        out = out.where(F.col("state_key") == state)
    if effort is not None:
        out = out.where(F.col("effort_uuid") == effort)
    if label is not None:
        tagged = members.where((F.col("set_name") == "labels") & (F.col("member") == label))
        out = out.join(tagged.select("entity_uuid"), "entity_uuid", "left_semi")
    if executor is not None:
        held = claims.where(F.col("executor") == executor)
        out = out.join(held.select("entity_uuid"), "entity_uuid", "left_semi")
    if unclaimed:
        out = out.join(claims.select("entity_uuid"), "entity_uuid", "left_anti")
    return out


def open_blockers(items: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``(entity_uuid, blocker)`` for live ``blocks`` edges from items not completed."""
    grouped = items.select("entity_uuid", "state_key").join(groups, "state_key", "left")
    unfinished = grouped.where(
        F.col("state_group").isNull() | (F.col("state_group") != "completed")
    ).select(F.col("entity_uuid").alias("from_uuid"))
    return (
        edges.where(F.col("relation_kind") == "blocks")
        .join(unfinished, "from_uuid", "left_semi")
        .select(F.col("to_uuid").alias("entity_uuid"), F.col("from_uuid").alias("blocker"))
    )


def unstarted(items: DataFrame, groups: DataFrame) -> DataFrame:
    return items.join(groups, "state_key").where(F.col("state_group") == "unstarted")


def ready_work(items: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Unstarted items that no unfinished item blocks."""
    return unstarted(items, groups).join(
        open_blockers(items, edges, groups).select("entity_uuid"), "entity_uuid", "left_anti"
    )


def blocked_work(items: DataFrame, edges: DataFrame, groups: DataFrame, part_items: int = LIST_ITEMS) -> DataFrame:
    """Unstarted items with their blockers, in parts of bounded length."""
    pairs = open_blockers(items, edges, groups).join(
        unstarted(items, groups).select("entity_uuid"), "entity_uuid", "left_semi"
    )
    return list_parts(pairs, ["entity_uuid"], F.col("blocker"), "blockers", part_items)


def inverse_edges(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges seen from their target, with the state of the source item."""
    names = F.create_map(*[F.lit(x) for p in INVERSE.items() for x in p])
    rows = edges.select(
        F.col("to_uuid").alias("entity_uuid"),
        F.try_element_at(names, F.col("relation_kind")).alias("relation"),
        F.col("from_uuid").alias("peer_uuid"),
    )
    peers = items.select(F.col("entity_uuid").alias("peer_uuid"), F.col("state_key").alias("peer_state"))
    return rows.join(peers, "peer_uuid", "left")


def duplicate_clusters(edges: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """Clusters of ``duplicates`` edges: size, completed members, rule kept or not."""
    pairs = edges.where(F.col("relation_kind") == "duplicates").select(
        F.col("from_uuid").alias("a"), F.col("to_uuid").alias("b")
    )
    done = items.join(groups, "state_key").where(F.col("state_group") == "completed")
    rows = components(pairs).join(
        done.select(F.col("entity_uuid").alias("id"), F.lit(1).alias("done")), "id", "left"
    )
    return (
        rows.groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("members"), F.count("done").alias("completed"))
        .withColumn("allowed", F.col("completed") <= 1)
    )


def effort_progress(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items per state group and the completed share of each effort."""
    group = F.col("state_group")
    return (
        items.join(groups, "state_key", "left")
        .groupBy("effort_uuid")
        .agg(
            F.count(F.lit(1)).alias("items"),
            *[F.count_if(group == g).alias(g) for g in GROUPS],
        )
        .withColumn("done_share", F.round(F.col("completed") / F.col("items"), 6))
    )


def dated_groups(changes: DataFrame, groups: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """State changes with their group and the group before (NULL for the first)."""
    order = [F.col("at_us"), F.col("event_uuid")]
    return ordered(
        changes.join(groups, "state_key", "left"),
        ["entity_uuid"],
        order,
        {"prev": previous_row(F.struct("state_key", "state_group"), order)},
        rows_per_split,
    )


def burndown(changes: DataFrame, groups: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Items per day and group at the end of the day.

    Every change is one step up in its new group and one down in the old one. Steps
    are summed per day first, so only days times groups rows are ever ordered, and
    no item is repeated for the days it stays in a state.
    """
    moves = F.array(
        F.struct(F.col("state_group").alias("g"), F.lit(1).alias("step")),
        F.struct(F.col("prev.state_group").alias("g"), F.lit(-1).alias("step")),
    )
    steps = (
        dated_groups(changes, groups, rows_per_split)
        .select(F.floor(F.col("at_us") / DAY_US).alias("day"), F.explode(moves).alias("m"))
        .where("m.g is not null")
        .groupBy("day", F.col("m.g").alias("state_group"))
        .agg(F.sum("m.step").alias("step"))
    )
    days = changes.agg(
        F.floor(F.min("at_us") / DAY_US).alias("lo"), F.floor(F.max("at_us") / DAY_US).alias("hi")
    ).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    calendar = days.withColumn("state_group", F.explode(F.array(*[F.lit(g) for g in GROUPS])))
    filled = calendar.join(steps, ["day", "state_group"], "left").fillna(0, ["step"])
    upto = Window.partitionBy("state_group").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("string").alias("day"),
        "state_group",
        F.sum("step").over(upto).alias("items"),
    )


def completed_at(changes: DataFrame, groups: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """When each now closed item entered its current closed stay."""
    closed = F.coalesce(F.col("state_group").isin(*CLOSED), F.lit(False))
    was = F.coalesce(F.col("prev.state_group").isin(*CLOSED), F.lit(False))
    order = F.struct("at_us", "event_uuid")
    return (
        dated_groups(changes, groups, rows_per_split)
        .groupBy("entity_uuid")
        .agg(
            F.max(F.when(closed & ~was, F.col("at_us"))).alias("completed_us"),
            F.max_by(F.struct(closed.alias("closed"), "state_key"), order).alias("now"),
        )
        .where("now.closed")
        .select("entity_uuid", "now.state_key", "completed_us")
    )


def cycle_times(changes: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Time spent per state over all finished stays."""
    order = [F.col("at_us"), F.col("event_uuid")]
    rows = ordered(
        changes,
        ["entity_uuid"],
        order,
        {"nxt": following_row(F.struct("at_us"), order)},
        rows_per_split,
    ).where("nxt is not null")
    spent = F.col("nxt.at_us") - F.col("at_us")
    return rows.groupBy("state_key").agg(
        F.count(F.lit(1)).alias("stays"),
        F.sum(spent).alias("total_us"),
        F.max(spent).alias("longest_us"),
        F.percentile_approx(spent, 0.5).alias("median_us"),
    )


def attention_queue(items: DataFrame, questions: DataFrame, state: str = "Needs Input") -> DataFrame:
    """Items that wait for a person: by state, by an open question, or both."""
    waiting = items.where(F.col("state_key") == state).select("entity_uuid", F.lit(True).alias("by_state"))
    asked = questions.select("entity_uuid", "comment_uuid", "directed_at")
    return waiting.join(asked, "entity_uuid", "full").select(
        "entity_uuid",
        "comment_uuid",
        "directed_at",
        F.when(F.col("by_state").isNull(), F.lit("question"))
        .when(F.col("comment_uuid").isNull(), F.lit("state"))
        .otherwise(F.lit("both"))
        .alias("reason"),
    )


def prefix_matches(wanted: DataFrame, items: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """``(ref, n, id)`` of the prefixes ``ref`` that items have: how many, and the least id.

    The ids that begin with a prefix are an interval of the sorted ids. Ids and the two ends
    of each interval are ranked in one ordered scan; the count is a difference of ranks.
    """
    low = wanted.select(F.col("ref").alias("at"), F.lit(0).alias("side"), "ref")
    high = wanted.select(F.concat("ref", F.lit("\U0010ffff")).alias("at"), F.lit(2).alias("side"), "ref")
    ids = items.select(F.col("entity_uuid").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("ref"))
    order = [F.col("at"), F.col("side"), F.col("ref")]
    before = running_sum((F.col("side") == 1).cast("bigint"))
    ranked = ordered(low.unionByName(ids).unionByName(high), [], order, {"rank": before}, rows_per_split)
    ends = ranked.where("side <> 1").groupBy("ref").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("high > low")
    first = ranked.where("side = 1").select((F.col("rank") - 1).alias("low"), F.col("at").alias("id"))
    return ends.join(first, "low").select("ref", (F.col("high") - F.col("low")).alias("n"), "id")


def resolve_references(
    refs: DataFrame, items: DataFrame, scheme: str = URN_SCHEME, rows_per_split: int | None = None
) -> DataFrame:
    """References (``ref``) to items: id, unique id prefix, URN or identifier.

    Ids are unique. Every form but the prefix is an equi-join. The best form wins; more than
    one candidate in it leaves the reference open.
    """
    wanted = refs.select("ref").distinct()
    urn = F.regexp_extract("ref", f"^{scheme}:[a-z]+:(.+)$", 1)
    prefixes = prefix_matches(wanted.where((F.length("ref") < 26) & (F.length("ref") > 0)), items, rows_per_split)
    one = lambda df, rank, form: df.select("ref", F.lit(rank).alias("rank"), F.lit(form).alias("form"), "n", "id")
    exact = wanted.join(items.select(F.col("entity_uuid").alias("ref")), "ref").select(
        "ref", F.lit(1).alias("n"), F.col("ref").alias("id")
    )
    by_urn = wanted.withColumn("id", urn).join(items.select(F.col("entity_uuid").alias("id")), "id").withColumn("n", F.lit(1))
    named = items.groupBy(F.col("identifier").alias("ref")).agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_uuid").alias("id")
    )
    found = (
        one(exact, 1, "id")
        .unionByName(one(prefixes, 2, "prefix"))
        .unionByName(one(by_urn, 3, "urn"))
        .unionByName(one(wanted.join(named, "ref"), 4, "identifier"))
        .groupBy("ref")
        .agg(F.min_by(F.struct("form", "n", "id"), "rank").alias("b"))
    )
    count = F.coalesce(F.col("b.n"), F.lit(0)).cast("bigint")
    return refs.join(found, "ref", "left").select(
        *refs.columns,
        F.col("b.form").alias("form"),
        count.alias("candidates"),
        F.when(count == 1, F.col("b.id")).alias("entity_uuid"),
    )


def ulid_time(text: Column) -> Column:
    """Milliseconds in the first ten characters of a ULID."""
    crockford, base32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    digits = F.translate(F.substring(F.upper(text), 1, 10), crockford, base32)
    return F.when(F.upper(text).rlike(ULID), F.conv(digits, 32, 10).cast("bigint"))


def allocate_numbers(items: DataFrame, rows_per_split: int | None = None) -> DataFrame:
    """Numbers for items without one: dense per project in ULID order after the
    highest given number. Given numbers never change."""
    top = items.groupBy("project_uuid").agg(F.coalesce(F.max("number"), F.lit(0)).alias("__top"))
    fresh = items.where(F.col("number").isNull()).withColumn("__ms", ulid_time(F.col("entity_uuid")))
    placed = ordered(
        fresh.withColumn("__ms", F.coalesce("__ms", F.lit(0))),
        ["project_uuid"],
        [F.col("__ms"), F.col("entity_uuid")],
        {"__place": position()},
        rows_per_split,
    ).join(top, "project_uuid")
    new = placed.withColumn("number", F.col("__top") + F.col("__place")).drop("__ms", "__place", "__top")
    both = items.where(F.col("number").isNotNull()).unionByName(new)
    return both.withColumn("identifier", F.concat_ws("-", "key", F.col("number").cast("string")))


def state_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two states, or that one of them lacks."""
    a = left.select(*keys, F.struct(F.col(value)).alias("__a"))
    b = right.select(*keys, F.struct(F.col(value)).alias("__b"))
    rows = a.join(b, keys, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return rows.select(
        *keys,
        F.col("__a")[value].alias("left_value"),
        F.col("__b")[value].alias("right_value"),
        F.when(F.col("__a").isNull(), F.lit("right_only"))
        .when(F.col("__b").isNull(), F.lit("left_only"))
        .otherwise(F.lit("differs"))
        .alias("difference"),
    )


def activity(log: DataFrame, columns: list[str]) -> DataFrame:
    """Event counts rolled up over the given columns."""
    return log.rollup(*columns).agg(
        F.count(F.lit(1)).alias("events"), F.grouping_id().cast("bigint").alias("level")
    )


def effort_status(efforts: DataFrame, today_us: int) -> DataFrame:
    """Planned, active or completed from dates; a set status overrides."""
    status = (
        F.when(F.col("given_status").isNotNull(), F.col("given_status"))
        .when(F.col("start_us").isNull() | (F.col("start_us") > today_us), F.lit("planned"))
        .when(F.col("end_us") < today_us, F.lit("completed"))
        .otherwise(F.lit("active"))
    )
    return efforts.withColumn("status", status)

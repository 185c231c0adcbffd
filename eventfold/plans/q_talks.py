"""Queries: comments, claims, blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import blobs, leases, threads
from eventfold.plans.adapters import claim_log, padded, table, tag, talk_log, text, with_k, with_parts
from eventfold.plans.registry import query

COMMENTS = """SELECT a.comment_uuid, a.entity_uuid, a.author, a.comment_kind, a.directed_at, a.replaces, b.body,
    a.hlc_us AS created_us, b.kind = 'comment.edit' AS edited,
    coalesce(d.hlc_us > a.hlc_us, FALSE) AS deleted
  FROM (SELECT *, row_number() OVER (PARTITION BY comment_uuid ORDER BY {desc}) AS rn FROM talks
    WHERE kind = 'comment.add') a
  JOIN (SELECT *, row_number() OVER (PARTITION BY comment_uuid ORDER BY {desc}) AS rn FROM talks
    WHERE kind IN ('comment.add', 'comment.edit')) b ON b.comment_uuid = a.comment_uuid AND b.rn = 1
  LEFT JOIN (SELECT comment_uuid, max(hlc_us) AS hlc_us FROM talks WHERE kind = 'comment.delete'
    GROUP BY comment_uuid) d ON d.comment_uuid = a.comment_uuid
  WHERE a.rn = 1"""
VISIBLE = """SELECT * FROM comments WHERE NOT deleted AND comment_uuid NOT IN
  (SELECT replaces FROM comments WHERE replaces IS NOT NULL)"""
TALK = {"comments": COMMENTS, "visible": VISIBLE}


@query(
    "d1_comments",
    with_parts(
        ["talks"],
        "SELECT comment_uuid, entity_uuid, author, body, created_us, edited, deleted FROM comments",
        TALK,
    ),
)
def comments(spark, sf):
    """Current comments: last add, last body after it, delete flag."""
    return threads.comments(talk_log(spark, sf)).select(
        "comment_uuid", "entity_uuid", "author", "body", "created_us", "edited", "deleted"
    )


@query("d2_visible_thread", with_parts(["talks"], "SELECT comment_uuid, entity_uuid, created_us, body FROM visible", TALK))
def visible_thread(spark, sf):
    """Thread as shown: no deleted and no replaced comments."""
    return threads.visible(threads.comments(talk_log(spark, sf))).select(
        "comment_uuid", "entity_uuid", "created_us", "body"
    )


@query(
    "d3_chain_heads",
    with_parts(
        ["talks"],
        """SELECT comment_uuid, head, CAST(max(hops) AS BIGINT) AS hops FROM (SELECT comment_uuid, arg_max(head, hops)
        OVER (PARTITION BY comment_uuid) AS head, hops FROM walk) GROUP BY comment_uuid, head""",
        {
            **TALK,
            "link": """SELECT replaces AS comment_uuid, max(comment_uuid) AS by FROM comments
            WHERE replaces IN (SELECT comment_uuid FROM comments) GROUP BY replaces""",
            "walk": """SELECT comment_uuid, comment_uuid AS head, 0 AS hops FROM comments
            UNION ALL SELECT w.comment_uuid, l.by, w.hops + 1 FROM walk w JOIN link l ON l.comment_uuid = w.head""",
        },
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def chain_heads(spark, sf):
    """Newest comment of each replacement chain and the hops to it."""
    return threads.chain_heads(threads.comments(talk_log(spark, sf)))


@query(
    "d4_open_questions",
    with_parts(
        ["talks"],
        "SELECT comment_uuid, entity_uuid, directed_at FROM visible WHERE comment_kind = 'needs_input'",
        TALK,
    ),
)
def open_questions(spark, sf):
    """Visible comments that ask a person for input."""
    return threads.open_questions(threads.comments(talk_log(spark, sf))).select(
        "comment_uuid", "entity_uuid", "directed_at"
    )


TURNS = {
    "turns": """SELECT *, lead(hlc_us) OVER w AS n_us, lead(kind) OVER w AS n_kind, lead(executor) OVER w AS n_exec
    FROM claims WHERE kind <> 'execution.progress' WINDOW w AS (PARTITION BY entity_uuid ORDER BY {o})""",
    "episodes": """SELECT entity_uuid, event_uuid, executor, hlc_us AS start_us,
    least(expires_us, coalesce(n_us, expires_us)) AS end_us,
    CASE WHEN n_us IS NULL OR expires_us <= n_us THEN 'expiry' WHEN n_kind = 'execution.release' THEN 'release'
      WHEN n_exec = executor THEN 'renewal' ELSE 'steal' END AS ended_by,
    least(expires_us, coalesce(n_us, expires_us)) - hlc_us AS held_us
    FROM turns WHERE kind = 'execution.claim'""",
}


@query(
    "d10_last_claims",
    with_parts(
        ["claims"],
        """SELECT entity_uuid, executor, expires_us, event_uuid FROM (SELECT *, row_number() OVER
        (PARTITION BY entity_uuid ORDER BY {desc}) AS rn FROM claims WHERE kind = 'execution.claim') WHERE rn = 1""",
    ),
)
def last_claims(spark, sf):
    """Last applied claim per item."""
    return leases.last_claims(claim_log(spark, sf))


@query(
    "d11_progress_log",
    with_parts(
        ["claims"],
        """SELECT event_uuid, entity_uuid, actor, holder, accepted, CASE WHEN accepted THEN row_number() OVER
          (PARTITION BY entity_uuid, accepted ORDER BY {o}) END AS sequence FROM judged""",
        {
            "held": """SELECT *, count(*) FILTER (kind <> 'execution.progress') OVER
              (PARTITION BY entity_uuid ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS turn_no FROM claims""",
            "turn_of": "SELECT entity_uuid, turn_no, executor, expires_us FROM held WHERE kind <> 'execution.progress'",
            "judged": """SELECT h.* EXCLUDE (executor, expires_us), t.executor AS holder,
              coalesce(t.executor = h.actor AND h.hlc_us < t.expires_us, FALSE) AS accepted
              FROM held h LEFT JOIN turn_of t ON t.entity_uuid = h.entity_uuid AND t.turn_no = h.turn_no
              WHERE h.kind = 'execution.progress'""",
        },
    ),
)
def progress_log(spark, sf):
    """Progress notes judged against the claim holder at their time, numbered."""
    return leases.progress_log(claim_log(spark, sf))


AT_US = 1705312800000000  # 2024-01-15T10:00


@query(
    "d12_active_claims",
    with_parts(
        ["claims"],
        f"SELECT entity_uuid, executor, start_us, end_us FROM episodes WHERE start_us <= {AT_US} AND {AT_US} < end_us",
        TURNS,
    ),
)
def active_claims(spark, sf):
    """Claims held at an instant: not expired, not released, not taken over."""
    spans = leases.episodes(claim_log(spark, sf))
    return leases.active_claims(spans, AT_US).select("entity_uuid", "executor", "start_us", "end_us")


@query("d13_claim_episodes", with_parts(["claims"], "SELECT * FROM episodes", TURNS))
def claim_episodes(spark, sf):
    """Claim spans with their end, its cause and the time held."""
    return leases.episodes(claim_log(spark, sf))


def blob_log(spark, sf):
    """Documents registered as blobs; clicks link and errors unlink them."""
    d = table(spark, sf, "documents")
    none = F.lit(None)
    adds = d.select(
        padded(F.col("doc_id")).alias("event_uuid"),
        F.lit("blob.add").alias("kind"),
        tag("B", F.col("doc_id")).alias("blob_uuid"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.concat(F.lit("text/"), F.col("lang")).alias("mime_type"),
        F.concat_ws("/", "source", text(F.col("doc_id"))).alias("file_name"),
        none.cast("string").alias("entity_uuid"),
        none.cast("string").alias("role"),
        F.col("doc_id").alias("stream_seq"),
    )
    i, k, t = F.col("event_id"), F.col("k"), F.col("event_type")
    moves = (
        with_k(table(spark, sf, "events"))
        .where(t.isin("click", "error"))
        .select(
            padded(i).alias("event_uuid"),
            F.when(t == "click", F.lit("blob.link")).otherwise(F.lit("blob.unlink")).alias("kind"),
            tag("B", k).alias("blob_uuid"),
            tag("E", F.col("user_id")).alias("entity_uuid"),
            F.when(k % 2 == 0, F.lit("attachment")).otherwise(F.lit("cover")).alias("role"),
            i.alias("stream_seq"),
        )
    )
    log = adds.unionByName(moves, allowMissingColumns=True)
    return log.select(
        "*",
        F.col("stream_seq").alias("hlc_us"),
        F.lit(0).alias("hlc_ns"),
        F.lit("N0").alias("hlc_node"),
        F.lit(0).cast("bigint").alias("hlc_seq"),
        F.lit("N0").alias("node_uuid"),
    )


LINKS = {
    "moves": """SELECT event_id, user_id, k, event_type, CASE k % 2 WHEN 0 THEN 'attachment' ELSE 'cover' END AS role,
    row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) AS rn FROM ev
    WHERE event_type IN ('click', 'error')"""
}


@query(
    "d14_blob_links",
    with_parts(
        ["ev"],
        """SELECT 'B' || k AS blob_uuid, 'E' || user_id AS entity_uuid, role, event_type = 'click' AS active,
        lpad(CAST(event_id AS VARCHAR), 26, '0') AS changed_by FROM moves WHERE rn = 1""",
        LINKS,
    ),
)
def blob_links(spark, sf):
    """Link state per blob, item and role; tombstones kept."""
    return blobs.links(blob_log(spark, sf))


@query(
    "d14_attachments",
    with_parts(
        ["ev"],
        """SELECT 'B' || k AS blob_uuid, 'E' || user_id AS entity_uuid, role,
        lpad(CAST(event_id AS VARCHAR), 26, '0') AS changed_by, sha256(text) AS sha256,
        CAST(strlen(text) AS BIGINT) AS size_bytes, 'text/' || lang AS mime_type, source || '/' || doc_id AS file_name
        FROM moves LEFT JOIN documents ON doc_id = k WHERE rn = 1 AND event_type = 'click'""",
        LINKS,
    ),
)
def attachments(spark, sf):
    """Active links with hash, size and name of their blob."""
    log = blob_log(spark, sf)
    return blobs.attachments(blobs.links(log), blobs.metadata(log))

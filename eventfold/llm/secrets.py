"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, give every longer token a log-likelihood ratio; tokens that the random model
explains better, by a margin for each character, are added to the pattern matches.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.common import folded, unfolded
from eventfold.operators.loops import cut

# Fixed patterns of the base kinds: (kind, pattern, group that is measured, least length).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]
MARKOV = "markov"
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ratio for each character above which a token is taken for random, and rows made for training.
MARGIN, MADE = 0.35, 6000
#: Pairs by which a character's chances lean on the frequency of the next one alone.
BACKOFF = 20.0
#: Labelled ordinary: words, names of words, plain numbers. Other tokens are judged and not learnt from.
ORDINARY = r"^[_/+=-]*(([A-Z]?[a-z]{2,})+|[A-Z]+|[0-9]+)([_/+=-]+(([A-Z]?[a-z]{2,})+|[A-Z]+|[0-9]+))*[_/+=-]*$"
# Fixed words for made identifiers.
WORDS = (
    "account address batch buffer cache channel client column config context count current customer data default "
    "document error event field file filter format frame group handler header image index input item kernel key "
    "language length level library list local manager message method model module name network number object option "
    "order output package page parser path payload process product provider query queue record region request "
    "resource response result schema search server service session source state status storage stream string "
    "support system table target template text thread time type update user value vector version view window "
    "worker zone"
).split()

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _matches(text: str, pattern: str, group: int) -> Column:
    """``gap, length, measured`` of each leftmost match: lengths before it, of it, of the group."""
    p = F.lit(pattern)
    found = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m))
    measured = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda m: F.length(m)) if group else found
    # What stands between the matches, so lengths alone give the places.
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("length"), measured.alias("measured"))
    return F.when(F.col(text).rlike(pattern), zipped)


def _spans(matches: str, kind_no: int, kind: str, least: int) -> Column:
    """The spans of matches, in code points, end exclusive, that measure ``least`` or more."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["length"]
        span = F.struct(
            start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind")
        )
        kept = F.when(m["measured"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    real = F.filter(matches, lambda m: m["length"].isNotNull())  # the last gap has no match
    return F.coalesce(F.aggregate(real, zero, add, lambda acc: acc["spans"]), F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, base, tokens, random)`` for each row of ``docs``.

    ``base`` are the pattern spans by start, then kind; ``tokens`` the spans of tokens that
    no base span touches, with their text; ``random`` the texts that the patterns caught.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = [*KINDS, (MARKOV, TOKEN, 0, 16)]
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("*", *[_matches("text", p, group).alias(f"m_{kind}") for kind, p, group, _ in kinds])
    rows = rows.select("doc_id", "text", *[_spans(f"m_{k[0]}", i, k[0], k[3]).alias(k[0]) for i, k in enumerate(kinds)])
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.col(k[0]) for k in KINDS])))
    free = F.filter(
        MARKOV, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )

    def said(s: Column) -> Column:
        return F.col("text").substr(s["start"] + 1, s["end"] - s["start"])

    caught = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: (F.length(v) >= 6) & v.rlike("[0-9]")),
        F.transform("access", said), F.transform("hex", said),
    )
    return rows.select(
        "doc_id", F.xxhash64("text").alias("row_key"), "base",
        F.transform(free, lambda t: F.struct(t.alias("span"), said(t).alias("token"))).alias("tokens"),
        F.when(F.size("base") > 0, caught).otherwise(F.array().cast("array<string>")).alias("random"),
    )


def made_random(spark: SparkSession, rows: int = MADE) -> DataFrame:
    """Labelled samples of random strings ``(token)``: digests as hex, base64 and capitals.

    They stand for keys that no pattern names; the count is a parameter, not data.
    """
    digest = F.sha2(F.concat(F.lit("made"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    kinds = F.pmod("id", F.lit(3))
    return spark.range(rows).select(
        F.when(kinds == 0, F.substring(digest, 1, 40)).when(kinds == 1, F.substring(packed, 1, 40))
        .otherwise(F.upper(F.regexp_replace(F.substring(packed, 1, 32), "[+/=]", ""))).alias("token")
    )


def made_ordinary(spark: SparkSession, rows: int = MADE) -> DataFrame:
    """Labelled samples of ordinary identifiers ``(token)``: joined words and plain numbers.

    They stand for names that a small table doesn't hold; the count is a parameter, not data.
    """
    words = F.array(*[F.lit(w) for w in WORDS])

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))) + 1).cast("int"))

    number = F.lpad(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(10**16)).cast("string"), 16, "0")
    three = [word(k) for k in range(3)]
    kinds = F.pmod("id", F.lit(6))
    return spark.range(rows).select(
        F.when(kinds == 0, F.concat_ws("_", *three)).when(kinds == 1, F.concat_ws("-", *three))
        .when(kinds == 2, F.concat_ws("/", *three)).when(kinds == 3, F.concat(three[0], *[F.initcap(w) for w in three[1:]]))
        .when(kinds == 4, F.upper(F.concat_ws("_", *three))).otherwise(number).alias("token")
    )


def bigrams(tokens: DataFrame) -> DataFrame:
    """``(token, a, b)`` for neighbouring characters; other columns stay."""
    at = F.sequence(F.lit(1), F.length("token") - 1)
    pairs = tokens.where(F.length("token") > 1).withColumn("i", F.explode(at))
    return pairs.withColumn("a", F.expr("substring(token, i, 1)")).withColumn("b", F.expr("substring(token, i + 1, 1)")).drop("i")


def train(samples: DataFrame, weight: float = BACKOFF) -> DataFrame:
    """``(a, b, ratio)`` of all pairs of the alphabet from samples ``(token, random, times)``.

    ``ratio`` is the log of the chance of ``b`` after ``a`` in random strings over that in
    ordinary ones. Either chance counts ``weight`` more pairs, shared out as ``b`` is
    frequent at all, so a character that a model has hardly seen isn't judged by the few
    pairs it was seen in. The table has a row for each two characters of the fixed
    alphabet, whatever the samples are.
    """
    counted = bigrams(samples).groupBy("a", "b").agg(
        F.sum(F.when(F.col("random"), F.col("times")).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("random"), 0).otherwise(F.col("times"))).alias("o"),
    )
    spark = samples.sparkSession
    signs = F.array(*[F.lit(c) for c in ALPHABET])
    pairs = spark.range(1).select(F.explode(signs).alias("a")).select("a", F.explode(signs).alias("b"))
    full = pairs.join(counted, ["a", "b"], "left").fillna(0)

    def chance(k: str) -> Column:
        # The windows see the pairs of the alphabet.
        own, of_b, every = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))
        common = (F.sum(k).over(of_b) + 1) / (F.sum(k).over(every) + len(ALPHABET))
        return (F.col(k) + weight * common) / (F.sum(k).over(own) + weight)

    return full.select("a", "b", (F.log(chance("r")) - F.log(chance("o"))).alias("ratio"))


def judged(tokens: DataFrame, model: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The tokens of ``(token)`` that are random by the models, with ``score``.

    Tokens of signs alone, such as rulers, aren't judged.
    """
    # One row for each pair of the fixed alphabet: 67 * 67 rows.
    scored = bigrams(tokens.where(F.col("token").rlike("[A-Za-z0-9]")).select("token").distinct()).join(F.broadcast(model), ["a", "b"])
    return scored.groupBy("token").agg(F.avg("ratio").alias("score")).where(F.col("score") > margin)


def scan(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``(doc_id, row_key, base, spans)`` for each row: pattern spans, and all spans.

    The random model learns from the strings that the patterns caught and from made ones,
    the ordinary model from the other tokens that look like words, names or numbers
    (``ORDINARY``) and from made ones; equal tokens count by the logarithm of how often
    they occur, so one string copied to a third of all rows isn't the model. Null and empty texts have no spans; repeated rows have equal ones; other
    columns are ignored; no rows give no rows.
    """
    rows = cut(base_spans(docs))
    tokens = rows.select(F.explode("tokens.token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    caught = rows.select(F.explode("random").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    times = F.log2(F.col("n") + 1.0)
    samples = (
        tokens.where(F.col("token").rlike(ORDINARY)).select("token", F.lit(False).alias("random"), times.alias("times"))
        .unionByName(caught.select("token", F.lit(True).alias("random"), times.alias("times")))
        .unionByName(made_random(docs.sparkSession).select("token", F.lit(True).alias("random"), F.lit(1.0).alias("times")))
        .unionByName(made_ordinary(docs.sparkSession).select("token", F.lit(False).alias("random"), F.lit(1.0).alias("times")))
    )
    odd = judged(tokens, cut(train(samples)), margin)
    at = rows.select("doc_id", "row_key", F.explode("tokens").alias("t")).select(
        "doc_id", "row_key", F.col("t.span").alias("span"), F.col("t.token").alias("token")
    )
    added = (
        at.join(odd.select("token"), "token").groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("added"))
        .withColumnRenamed("doc_id", "_id").withColumnRenamed("row_key", "_key")
    )
    met = rows.join(added, rows["doc_id"].eqNullSafe(added["_id"]) & (F.col("row_key") == F.col("_key")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return met.select("doc_id", "row_key", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redacted(docs: DataFrame, mark: str = "[secret]", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``.

    All rows stay; ``n_chars`` is counted again where there is such a column.
    """
    found = scan(docs, margin).where(F.size("spans") > 0).groupBy("doc_id", "row_key").agg(F.first("spans").alias("_spans"))
    found = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("row_key", "_key")
    rows = folded(docs, doc_id=F.col("doc_id"), text=F.col("text"), row=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    met = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (F.col("row") == F.col("_key")), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        before = F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["parts"], F.array(before, F.lit(mark)))).otherwise(acc["parts"]).alias("parts"),
        )

    clean = F.aggregate(
        "_spans", start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.expr("text").substr(acc["at"] + 1, F.length("text"))),
    )
    hit = F.col("_spans").isNotNull()
    met = met.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    more = {}
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        more["n_chars"] = F.when(hit, counted).otherwise(F.col("_doc.n_chars"))
    return unfolded(met, docs, text=F.col("text"), **more)

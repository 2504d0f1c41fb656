"""Problem 6: ordered conversations from message rows.

Rows without a session are put into conversations first: they are nodes, their
reply links (``reply_to``, an ``ord``) and quotes (lines that begin with ``>``
and repeat a line of an earlier row; each leads to the nearest one) are edges, and
each connected component, found by alternating large-star and small-star joins,
is a conversation. It
takes the smallest session id a row of it carries, else an id of its own.

Then repeated deliveries are reduced to the row that counts, rows are put in
order, and each conversation is validated by mergeable summaries.

Defined results: role spellings are folded by ``ROLES``, any other (null and
empty too) can't be told; texts of white space and JSON arrays without text are
empty; text that merely looks like JSON stays text; times are read as ISO text
(UTC where no zone is given) or epoch seconds, milliseconds or microseconds; rows
without a time come after those with one, by arrival. Sessions of any length are
ordered in slices, so none has to fit into one task. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.slices import running_before, with_slices
from lodestrata.session import staged

#: Spellings of the speakers, lower-cased and trimmed (fixed values).
ROLES = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "model": "assistant",
    "bot": "assistant",
    "system": "system",
    "developer": "system",
    "tool": "tool",
    "function": "tool",
}
#: Characters of a line from which a repetition behind ``>`` is a quote.
QUOTE_LENGTH = 20


def role_of(role: str | Column) -> Column:
    """user, assistant, system, tool, or null where it can't be told."""
    col = F.col(role) if isinstance(role, str) else role
    folded = F.lower(F.trim(col))
    result = F.lit(None).cast("string")
    for name in dict.fromkeys(ROLES.values()):
        result = F.when(folded.isin([k for k, v in ROLES.items() if v == name]), F.lit(name)).otherwise(result)
    return result


def text_of(content: str | Column) -> Column:
    """Plain text, or the texts of a JSON array of parts, one per line; null is empty."""
    col = F.col(content) if isinstance(content, str) else content
    parts = F.when(col.startswith("["), F.from_json(col, "array<struct<type:string,text:string>>"))
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    strings = F.when(col.startswith('["'), F.from_json(col, "array<string>"))
    empty_array = col.rlike(r"^\[\s*\]\s*$")
    return F.coalesce(F.when(empty_array, F.lit("")), F.array_join(strings, "\n"), F.when(F.size(F.filter(parts, lambda p: p.isNotNull())) > 0, joined), col, F.lit(""))


def instant_of(stamp: str | Column) -> Column:
    """Microseconds since 1970 of a time in any of the forms, or null."""
    col = F.trim(F.col(stamp) if isinstance(stamp, str) else stamp)
    digits = col.try_cast("decimal(38,0)")
    size = F.length(col)
    epoch = F.when(size <= 11, digits * 1_000_000).when(size <= 14, digits * 1_000).when(size <= 17, digits).otherwise(F.floor(digits / 1_000))
    zoned = F.when(col.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), col).otherwise(F.concat(col, F.lit("Z")))
    return F.when(col.rlike(r"^\d{9,19}$"), epoch.cast("bigint")).otherwise(F.unix_micros(F.try_to_timestamp(zoned)))


def nearest_earlier(rows: DataFrame) -> DataFrame:
    """``u``, ``v``, ``others``: for each asking row the nearest earlier one of its key that doesn't ask, and how many
    rows of the key don't ask.

    ``rows`` has ``key``, ``ord``, ``at`` (double) and ``asks``. A key that a third
    of all rows have is searched in slices of time.
    """
    asked = rows.where("asks").select("key").distinct()
    rows = rows.join(asked, "key", "left_semi").withColumn("_k", F.struct("at", F.col("ord").alias("o")))
    cut = with_slices(rows, ["key"], "at")
    origin = F.when(~F.col("asks"), F.col("_k"))
    inside = Window.partitionBy("key", "_slice").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("key", "_slice").agg(F.max(origin).alias("_last"), F.count(origin).alias("_n"))
    before = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "_slice", F.last("_last", True).over(before).alias("_carried"), F.sum("_n").over(Window.partitionBy("key")).alias("others"))
    found = cut.withColumn("_own", F.last(origin, True).over(inside)).where("asks").join(carried, ["key", "_slice"])
    return found.select(F.col("ord").alias("u"), F.coalesce("_own", "_carried")["o"].alias("v"), "others").where("v is not null and u <> v")


def quote_links(messages: DataFrame) -> DataFrame:
    """``u``, ``v``: rows and the earlier rows they quote.

    A quoted line leads to the nearest earlier row, by time and not by arrival,
    that has it. Lines that only one row has decide; where a row quotes none,
    lines that several rows have (greetings, boilerplate) do.
    """
    at = F.coalesce(instant_of("msg_timestamp"), F.unix_micros(F.col("received_at").cast("timestamp"))).cast("double")
    lines = messages.select("ord", F.coalesce(at, F.lit(0.0)).alias("at"), F.explode(F.split(text_of("content"), r"\r\n|\r|\n")).alias("line")).select(
        "ord", "at", F.col("line").startswith(">").alias("asks"), F.lower(F.trim(F.regexp_replace("line", r"^>+\s*", ""))).alias("line")
    )
    lines = lines.where(F.char_length("line") >= QUOTE_LENGTH).select("ord", "at", "asks", F.sha2("line", 256).alias("key")).distinct()
    found = staged(nearest_earlier(lines), "quotes")
    sure = found.where("others = 1")
    return sure.unionByName(found.join(sure.select("u").distinct(), "u", "left_anti")).select("u", "v").distinct()


def number_links(messages: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``u``, ``v``: among rows that lack a session, the number before of the same source, nearest in time, is replied to;
    a number delivered again belongs to the delivery before. Only rows equal in the columns ``within`` are linked."""
    at = F.coalesce(instant_of("msg_timestamp"), F.unix_micros(F.col("received_at").cast("timestamp"))).cast("double")
    rows = messages.where("session_id is null and message_id is not null").select("ord", F.coalesce(at, F.lit(0.0)).alias("at"), "source", "message_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("c"), *within)
    name = lambda n: F.concat_ws("|", *(F.col(w).cast("string") for w in within), F.coalesce("source", F.lit("")), n.cast("string"))
    asks = rows.where("message_id > 1").select("ord", "at", name(F.col("message_id") - 1).alias("key"), F.lit(True).alias("asks"))
    heard = rows.select("ord", "at", name(F.col("message_id")).alias("key"), F.lit(False).alias("asks"))
    replies = nearest_earlier(asks.unionByName(heard)).select("u", "v")
    again = rows.groupBy(name(F.col("message_id")).alias("key"), "at", "c").agg(F.min("ord").alias("v"))
    repeated = rows.select(F.col("ord").alias("u"), name(F.col("message_id")).alias("key"), "at", "c").join(again, ["key", "at", "c"]).where("u <> v")
    return replies.unionByName(repeated.select("u", "v"))


def said_links(messages: DataFrame) -> DataFrame:
    """``u``, ``v``: rows and the rows they quote or reply to."""
    links = quote_links(messages)
    if "reply_to" in messages.columns:
        links = links.unionByName(messages.where("reply_to is not null").select(F.col("ord").alias("u"), F.col("reply_to").cast("bigint").alias("v")))
    return links


def named(lacking: DataFrame, parts: DataFrame, known: DataFrame) -> DataFrame:
    """``ord``, ``_found``: rows and the smallest session that ``known`` has in their component, else an id of its own."""
    known = parts.join(known, "node").groupBy("component").agg(F.min("session_id").alias("_known"))
    return lacking.join(parts.withColumnRenamed("node", "ord"), "ord", "left").join(known, "component", "left").select(
        "ord", F.coalesce("_known", F.concat(F.lit("conversation-"), F.coalesce("component", "ord").cast("string"))).alias("_found")
    )


def assign_conversations(messages: DataFrame, numbered: bool = False) -> DataFrame:
    """``messages`` with every row's ``session_id`` filled in; ``numbered`` takes message numbers as replies too."""
    if not messages.where(F.col("session_id").isNull()).take(1):
        return messages
    links = said_links(messages)
    if numbered:
        links = links.unionByName(number_links(messages))
    lacking = messages.where(F.col("session_id").isNull()).select("ord")
    touched = links.join(lacking.select(F.col("ord").alias("u")), "u", "left_semi").unionByName(links.join(lacking.select(F.col("ord").alias("v")), "v", "left_semi").select("u", "v"))
    found = named(lacking, connected_components(touched), messages.where(F.col("session_id").isNotNull()).select(F.col("ord").alias("node"), "session_id"))
    return messages.join(found, "ord", "left").withColumn("session_id", F.coalesce("session_id", "_found")).drop("_found")


def relinked(messages: DataFrame, every: int = 10) -> DataFrame:
    """How well conversations are found again: one row with ``sessions``, ``rows``, ``precision`` and ``recall`` of pairs of rows.

    Sessions fall into ``every`` parts by their hash. The ids of each part are hidden in turn while all other rows stay
    as they are, so every session is looked for once. Pairs of rows of which at least one is hidden count, those with
    a row that kept its id too. All parts go in one pass: a node is a part and a row.
    """
    part = F.pmod(F.xxhash64("session_id"), F.lit(every))
    # a row that has no session lacks it in every part
    parts = F.when(F.col("session_id").isNull(), F.sequence(F.lit(0), F.lit(every - 1)).cast("array<bigint>")).otherwise(F.array(part))
    lacking = messages.withColumn("part", F.explode(parts)).withColumn("_true", F.col("session_id")).withColumn("session_id", F.lit(None).cast("string"))
    links = said_links(messages)
    node = lambda end: F.struct("part", F.col(end).alias("ord"))
    touched = number_links(lacking.withColumn("ord", node("ord")), ("part",))
    for end in ("u", "v"):
        touched = touched.unionByName(links.join(lacking.select(F.col("ord").alias(end), "part"), end).select(node("u").alias("u"), node("v").alias("v")))
    components = connected_components(touched)
    own = messages.where("session_id is not null").select(F.col("ord").alias("_row"), "session_id", part.alias("_own"))
    known = components.join(own, (F.col("node.ord") == F.col("_row")) & (F.col("node.part") != F.col("_own"))).select("node", "session_id")
    true = lacking.where("_true is not null").select(node("ord").alias("ord"), "_true")
    # rows that a session keeps while another part is hidden
    kept = messages.where("session_id is not null").groupBy(F.col("session_id").alias("_found")).agg(F.count("*").alias("kept"))
    both = staged(named(true.select("ord"), components, known).join(true, "ord").select("ord.part", "_true", "_found"), "relinked")
    ways = {"hit": ["_true", "_found"], "found": ["part", "_found"], "true": ["_true"]}
    counted = None
    for name, by in ways.items():
        groups = both.groupBy(*by).agg(F.count("*").alias("n"))
        groups = groups.join(kept, "_found", "left") if name == "found" else groups.withColumn("kept", F.lit(0))
        pairs = F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.coalesce("kept", F.lit(0))
        one = groups.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("pairs"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn("way", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    value = lambda column, way: F.max(F.when(F.col("way") == way, F.col(column)))
    share = lambda whole: F.round(F.when(value("pairs", whole) > 0, value("pairs", "hit") / value("pairs", whole)).otherwise(F.lit(1.0)), 4)
    return counted.agg(value("groups", "true").alias("sessions"), value("rows", "true").alias("rows"), share("found").alias("precision"), share("true").alias("recall"))


def counting_rows(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """The row that counts of each delivery: session, id, role, time, and whether there is text.

    What is needed of a row is worked out before the shuffle; its content only
    travels if ``with_text`` asks for it.
    """
    text = text_of("content")
    rows = messages.select(
        "session_id",
        "ord",
        "message_id",
        "received_at",
        role_of("role").alias("speaker"),
        F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("_role"),
        instant_of("msg_timestamp").alias("instant"),
        text.rlike(r"(?U)\S").alias("has_text"),
        *([text.alias("text")] if with_text else []),
        F.sha2(F.coalesce(F.concat(F.lit("c"), "content"), F.lit("")), 256).alias("_content"),
    )
    rows = rows.withColumn(
        "_same", F.when(F.col("message_id").isNull(), F.concat_ws("|", F.coalesce("speaker", "_role"), F.coalesce(F.col("instant").cast("string"), F.lit("-")), "_content"))
    )
    kept = ["ord", "speaker", "instant", "has_text", *(["text"] if with_text else [])]
    newest = F.struct(F.col("received_at"), F.col("ord").alias("_o"))
    return rows.groupBy("session_id", "message_id", "_same").agg(F.max_by(F.struct("received_at", *kept), newest).alias("_row")).select("session_id", "message_id", "_row.*")


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds ``_at`` (coarse order as a number), ``_slice`` and ``_key`` (full order)."""
    # rows without number and time come after those with, by arrival
    at = F.coalesce(F.col("message_id").cast("double"), F.col("instant").cast("double"), F.lit(1e18) + F.unix_micros(F.col("received_at").cast("timestamp")).cast("double"), F.lit(3e17) + F.least(F.col("ord").cast("double"), F.lit(5e17)))
    key = F.struct(F.coalesce("message_id", F.coalesce("instant", F.lit(2**63 - 1))).alias("a"), F.col("received_at").alias("b"), F.col("ord").alias("c"))
    return with_slices(rows.withColumn("_at", at).withColumn("_key", key), ["session_id"], "_at")


def session_faults(rows: DataFrame) -> DataFrame:
    """Per session of ``counting_rows`` which rules it breaks.

    Result: ``session_id``, ``hole``, ``unknown_role``, ``no_text``,
    ``starts_without_user``, ``unanswered``.
    """
    talk = F.col("speaker").isin("user", "assistant")
    own = rows.groupBy("session_id").agg(
        F.coalesce((F.count("message_id") > 0) & ((F.min("message_id") != 1) | (F.max("message_id") != F.count("message_id"))), F.lit(False)).alias("hole"),
        F.max(F.col("speaker").isNull()).alias("unknown_role"),
        (~F.coalesce(F.max(talk & F.col("has_text")), F.lit(False))).alias("no_text"),
    )
    turns = _ordered(rows).where(talk)
    first = turns.groupBy("session_id").agg(F.min_by("speaker", "_key").alias("_first"))
    # a user turn is answered if the next row among user turns and assistant turns with text is an assistant's
    signs = turns.where((F.col("speaker") == "user") | F.col("has_text")).withColumn("_user", F.col("speaker") == "user")
    inside = Window.partitionBy("session_id", "_slice").orderBy("_key")
    marked = signs.withColumn("_next", F.lead("_user").over(inside))
    slices = marked.groupBy("session_id", "_slice").agg(
        F.min_by("_user", "_key").alias("_opens"), F.max_by("_user", "_key").alias("_closes"), F.max(F.col("_user") & F.coalesce("_next", F.lit(False))).alias("_open_inside")
    )
    across = Window.partitionBy("session_id").orderBy("_slice")
    unanswered = (
        slices.withColumn("_then", F.coalesce(F.lead("_opens").over(across), F.lit(True)))
        .groupBy("session_id")
        .agg(F.max(F.col("_open_inside") | (F.col("_closes") & F.col("_then"))).alias("unanswered"))
    )
    return (
        own.join(first, "session_id", "left")
        .join(unanswered, "session_id", "left")
        .select(
            "session_id",
            "hole",
            "unknown_role",
            "no_text",
            F.coalesce(F.col("_first") != "user", F.lit(False)).alias("starts_without_user"),
            F.coalesce("unanswered", F.lit(False)).alias("unanswered"),
        )
    )


BROKEN = "hole or unknown_role or no_text or starts_without_user or unanswered"


def dropped_sessions(messages: DataFrame) -> DataFrame:
    """``session_id`` of each session that isn't kept."""
    # written once; ordering and rules read it several times
    return session_faults(staged(counting_rows(assign_conversations(messages)), "rows")).where(BROKEN).select("session_id")


def conversations(messages: DataFrame) -> DataFrame:
    """Kept sessions as ordered turns.

    Result: ``session_id``, ``turn_no`` (from 1), ``speaker``, ``text``, ``at``.
    """
    rows = staged(counting_rows(assign_conversations(messages), with_text=True), "rows")
    kept = session_faults(rows.drop("text")).where(f"not ({BROKEN})").select("session_id")
    ordered = _ordered(rows.join(kept, "session_id", "left_semi")).withColumn("_one", F.lit(1))
    numbered = running_before(ordered, ["session_id"], "_key", "_one", "_before")
    return numbered.select(
        "session_id", (F.col("_before") + 1).cast("bigint").alias("turn_no"), "speaker", "text", F.expr("timestamp_micros(instant)").alias("at")
    )

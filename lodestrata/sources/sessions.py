"""Session records (JSON, JSONL) into session and turn nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestrata.functions import text as T
from lodestrata.operators import graphstore as G

TURN_CUT, SESSION_CUT = 100_000, 300_000


def next_chain(turns: DataFrame, group: list[str], order: str, id_: str | None = None) -> DataFrame:
    """``previous``: the turn before each in its session."""
    return turns.withColumn("previous", F.lag(id_ or order).over(Window.partitionBy(*group).orderBy(order)))


def session_texts(turns: DataFrame, session: str, text: str, order: str, cut: int = SESSION_CUT, trimmed: bool = False) -> DataFrame:
    """``session``, ``text``: turn texts in order, those already contained left out, one per line, cut at ``cut``.

    Turns pass in order, and only the text of the session at hand is held. Once
    that is ``cut`` long, what follows would be cut off. ``trimmed`` drops outer
    white space after each turn.
    """
    whole = (lambda x: x.strip()[:cut]) if trimmed else (lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, joined, started, kind = None, "", False, None
        for batch in batches:
            kind = batch.column(0).type
            done: list[tuple] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not started or key != at:
                    if started:
                        done.append((at, joined[:cut]))
                    at, joined, started = key, whole(t), True
                elif len(joined) < cut and t not in joined:
                    joined = whole(joined + "\n" + t)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([t for _, t in done], pa.string())], names=[session, "text"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([joined[:cut]], pa.string())], names=[session, "text"])

    rows = turns.where(T.filled(text)).select(F.col(session).alias("s"), F.col(order).alias("o"), F.col(text).alias("t"))
    schema = StructType([StructField(session, turns.schema[session].dataType), StructField("text", StringType())])
    return rows.repartition("s").sortWithinPartitions("s", "o", "t").mapInArrow(run, schema)


def parse_records(files: DataFrame) -> DataFrame:
    """``path``, ``file_no``, ``pos``, ``record`` (JSON text) of files with ``path``, ``file_no`` and ``text``.

    A ``.jsonl`` file has one record per line that isn't blank, and none at all
    if any line isn't JSON. A ``.json`` file is an array, an object with a
    ``sessions`` array, or one record. Other files have none.
    """
    ext = T.extension("path")
    lines = files.where(ext == ".jsonl").select("path", "file_no", F.posexplode(F.filter(F.split("text", r"\r?\n"), T.filled)).alias("pos", "record"))
    bad = lines.where(F.try_parse_json("record").isNull()).select("path").distinct()
    whole = files.where(ext == ".json").select("path", "file_no", "text", F.try_parse_json("text").alias("v")).where("v is not null")
    array = "array<string>"
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.from_json(F.col("text"), array)).when(
        F.get_json_object("text", "$.sessions").startswith("["), F.from_json(F.get_json_object("text", "$.sessions"), array)
    ).otherwise(F.array("text"))
    single = whole.select("path", "file_no", F.posexplode(items).alias("pos", "record"))
    return lines.join(bad, "path", "left_anti").unionByName(single)


#: Where a turn or session stands: file, record, turn. Any number of a file has room for so many of each, as many as an array has.
RECORDS, TURNS = 1 << 31, 1 << 31
PLACE = "decimal(38,0)"


def place(record: Column | str | None = None, turn: Column | int = 0) -> Column:
    """The position of a turn, record or file; too large for a bigint, whose place it takes until a store numbers what it merges."""
    at = F.col("file_no").cast(PLACE) * RECORDS
    at = at if record is None else at + T.col(record)
    return (at * TURNS + (F.lit(turn) if isinstance(turn, int) else turn)).cast(PLACE)


def session_records(records: DataFrame) -> DataFrame:
    """One row per record that is a session or a turn of one: ``path, file_no, record_no, shape, session_id, label``, what its
    metadata is made of, and ``messages`` (variants).

    Shapes: a session with ``messages``, a prompt with ``text`` and
    ``session_id``, a trace row with an object ``message`` and ``type`` user,
    assistant or tool. Strings and numbers count as text, other values don't.
    """
    v = F.col("v")
    at = lambda name: T.variant_at(v, name)
    text = lambda name: T.variant_text(at(name))
    first = lambda *names: F.coalesce(*(F.when(~T.variant_kind(at(n)).eqNullSafe("VOID"), at(n)) for n in names))
    rows = records.select("path", "file_no", F.col("pos").alias("record_no"), F.try_parse_json("record").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    shape = (
        F.when(T.variant_kind(at("messages")).startswith("ARRAY"), "messages")
        .when(text("text").isNotNull() & text("session_id").isNotNull(), "prompt")
        .when(T.variant_kind(at("message")).startswith("OBJECT") & text("type").isin("user", "assistant", "tool"), "trace")
    )
    fallback = lambda name: F.concat(F.lit("import-"), T.stable_id(name))
    numbered = F.concat("path", F.lit(":"), F.col("record_no").cast("string"))
    sid = F.when(F.col("shape") == "messages", F.coalesce(text("id"), text("session_id"), fallback(numbered))).when(F.col("shape") == "prompt", text("session_id")).otherwise(
        F.coalesce(text("session_id"), text("sessionId"), fallback(F.col("path")))
    )
    index = F.when(T.variant_kind(at("index")).rlike("^(BIGINT|INT|DOUBLE|DECIMAL)"), F.try_variant_get(at("index"), "$", "bigint"))
    return (
        rows.withColumn("shape", shape).where("shape is not null").withColumn("session_id", sid)
        .select(
            "path", "file_no", "record_no", "shape", "session_id", F.when(F.col("shape") == "messages", F.coalesce(text("title"), F.col("session_id"))).otherwise(F.col("session_id")).alias("label"),
            F.coalesce(text("source"), F.lit("agent-export")).alias("source"), text("model").alias("model"), first("started_at", "startedAt", "created_at").alias("startedAt"),
            first("parent_session_id", "parentSessionID").alias("parentSessionID"), text("type").alias("type"), text("text").alias("said"),
            F.when(F.col("shape") == "messages", F.try_variant_get(at("messages"), "$", "array<variant>")).when(F.col("shape") == "prompt", F.array(v)).otherwise(F.array(at("message"))).alias("messages"),
            F.when(F.col("shape") == "prompt", F.coalesce(index, F.col("record_no"))).when(F.col("shape") == "trace", F.col("record_no")).alias("own_index"),
        )
    )


def session_turns(records: DataFrame) -> DataFrame:
    """One row per turn: ``path, file_no, record_no, shape, session_id, turn_index, message_id, role, text, timestamp, tool``.

    System messages of a session are dropped, positions kept; blank texts give no turn.
    """
    m = F.col("m")
    at = lambda name: T.variant_at(m, name)
    told = lambda *names: F.coalesce(*(F.when(~T.variant_kind(at(n)).eqNullSafe("VOID"), at(n)) for n in names))
    each = session_records(records).select("path", "file_no", "record_no", "shape", "session_id", "type", "said", "own_index", F.posexplode("messages").alias("no", "m")).where(F.schema_of_variant("m").startswith("OBJECT"))
    each = each.where(~((F.col("shape") == "messages") & F.coalesce(T.variant_text(at("role")) == "system", F.lit(False))))
    index = F.coalesce("own_index", "no").cast("bigint")
    role = F.coalesce(T.variant_text(at("role")), F.when(F.col("shape") == "trace", F.col("type")), F.lit("unknown"))
    return each.select(
        "path", "file_no", "record_no", "shape", "session_id", F.col("no").alias("turn_no"), index.alias("turn_index"), F.coalesce(T.variant_text(at("id")), T.variant_text(at("message_id")), index.cast("string")).alias("message_id"),
        role.alias("role"), F.when(F.col("shape") == "prompt", F.col("said")).otherwise(T.variant_message(at("content"))).alias("text"), told("timestamp", "created_at").alias("timestamp"), told("tool_name", "name").alias("tool"),
    ).where(T.filled("text"))


def session_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session and turn nodes of records; HAS_TURN and keyword edges, and NEXT edges within the messages of one record."""
    sid = F.concat(F.lit("session:"), T.stable_id(F.concat_ws(":", "path", "session_id")))
    tid = F.concat(F.lit("turn:"), T.stable_id(F.concat_ws(":", "path", "session_id", "message_id", "role")))
    heads = session_records(records).withColumn("sid", sid).withColumn("ord", place("record_no"))
    t = session_turns(records).withColumn("sid", sid).withColumn("tid", tid).withColumn("ord", place("record_no", F.col("turn_no") + 1))
    null = F.lit(None).cast("string")
    meta = F.to_json(F.struct(F.col("session_id").alias("sessionID"), "role", F.col("turn_index").alias("index"), F.col("message_id").alias("messageID"), "timestamp", F.col("tool").alias("toolName"), F.lit("agent-turn").alias("kind")))
    turns = t.select(F.col("tid").alias("id"), F.lit("turn").alias("node_type"), F.concat("role", F.lit(" "), (F.col("turn_index") + 1).cast("string")).alias("label"), F.substring("text", 1, TURN_CUT).alias("text"), "path", meta.alias("metadata"), "ord")
    about = F.to_json(F.struct(F.col("session_id").alias("sessionID"), "source", "model", "startedAt", "parentSessionID", F.lit("agent-session").alias("kind")))
    last = heads.select("sid", "ord", "label", "path", about.alias("metadata")).groupBy("sid").agg(F.max_by(F.struct("label", "path", "metadata"), "ord").alias("v"), F.min("ord").alias("ord"))
    sessions = last.join(session_texts(t, "sid", "text", "ord", trimmed=True), "sid", "left").select(
        F.col("sid").alias("id"), F.lit("session").alias("node_type"), "v.label", F.coalesce("text", F.lit("")).alias("text"), "v.path", "v.metadata", "ord"
    )
    edge = lambda src, dst, kind: (F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), null.alias("metadata"), F.col("ord"))
    has = t.select(*edge("sid", "tid", "HAS_TURN"))
    chain = next_chain(t.where("shape = 'messages'"), ["path", "record_no"], "turn_no", "tid").where("previous is not null and previous <> tid")
    keywords, tagged = G.tag_keywords(t.select(F.col("tid").alias("id"), "text", "ord"), F.slice(T.tokens("text"), 1, 24))
    return turns.unionByName(sessions).unionByName(keywords), has.unionByName(chain.select(*edge("previous", "tid", "NEXT"))).unionByName(tagged)

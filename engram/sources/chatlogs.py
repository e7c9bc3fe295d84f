"""Chat logs of several layouts as sessions, read by Spark alone.

A file is one session. Every reader makes a table of messages (file, place, role, text, and what it knows of the file)
and `assemble` folds it: transcript in order, first question, last answer. Files that can't be used are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import schemas
from engram.functions import text as T
from engram.operators import stories
from engram.params import DEFAULTS

_BLOCKS = "array<struct<type:string,text:string>>"
_TEXT_BLOCKS = ("text", "input_text", "output_text")
#: Events of a rollout that a transcript mentions, and keys of an export that hold chats.
ROLLOUT_EVENTS = ("turn_aborted", "stream_error", "task_complete")
CHAT_KEYS = r"(?i)aiService|aichat|cursor.*chat"


def content_text(content: Column) -> Column:
    """Text of a message's content, which is a string or a JSON array of blocks; secrets redacted."""
    parts = F.filter(F.from_json(content, _BLOCKS), lambda b: b["type"].isin(*_TEXT_BLOCKS))
    texts = F.filter(F.transform(parts, lambda b: F.trim(T.redact(F.coalesce(b["text"], F.lit(""))))), lambda t: t != "")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & F.from_json(content, _BLOCKS).isNotNull(), F.array_join(texts, "\n")).otherwise(F.trim(T.redact(F.coalesce(content, F.lit("")))))


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, body: whole files, each a session."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line: lines that end with a newline; what follows the last one is still being written."""
    lines = F.split("body", "\n")
    return files(spark, path).select("file", F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("place", "line")).filter(F.trim("line") != "")


def assemble(messages: DataFrame, cap: int = DEFAULTS.transcript_chars) -> DataFrame:
    """file, external_id, raw_content, problem_desc, conclusion, n_invalid, usable of messages.

    messages: file, place, role, text (null: none), external_id, title, invalid.
    """
    shown = F.col("text").isNotNull() & (F.col("text") != "")
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, F.col("place")))
    lines = messages.withColumn("line", F.when(shown, F.concat(F.lit("["), "role", F.lit("] "), "text")))
    out = stories.reaching(lines, "file", "place", "line", cap).groupBy("file").agg(
        first("external_id", F.col("external_id").isNotNull()).alias("external_id"), first("title", F.col("title").isNotNull()).alias("title"),
        stories.transcript("place", "line", cap).alias("raw_content"),
        first("text", shown & (F.col("role") == "user")).alias("asked"), F.max_by(F.when(shown & (F.col("role") == "assistant"), F.col("text")), F.when(shown & (F.col("role") == "assistant"), F.col("place"))).alias("answered"),
        F.sum(F.col("invalid").cast("long")).alias("n_invalid"),
    )
    return out.select("file", "external_id", "raw_content", F.substring(F.coalesce("title", "asked", F.lit("")), 1, 200).alias("problem_desc"), F.substring(F.coalesce("answered", F.lit("")), 1, 300).alias("conclusion"), "n_invalid", (F.col("external_id").isNotNull() & F.col("asked").isNotNull()).alias("usable"))


def _messages(rows: DataFrame, role: Column, text: Column, external: Column, title: Column, invalid: Column) -> DataFrame:
    return rows.select("file", "place", role.alias("role"), text.alias("text"), external.alias("external_id"), title.alias("title"), invalid.alias("invalid"))


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Rollout JSONL: a session_meta record with the id, response items, tool calls and a few events."""
    return rollout_sessions(complete_lines(spark, path))


def rollout_sessions(lines: DataFrame) -> DataFrame:
    """The same from lines (file, place, line) that have been read."""
    schema = "type string, payload string"
    payload = "id string, session_id string, type string, role string, name string, content string"
    rows = lines.withColumn("r", F.from_json("line", schema)).withColumn("p", F.from_json("r.payload", payload))
    broken = F.col("r.payload").isNull() | ~F.startswith(F.ltrim("r.payload"), F.lit("{"))
    kind, part = F.col("r.type"), F.col("p.type")
    spoken = (kind == "response_item") & (part == "message") & F.col("p.role").isin("user", "assistant")
    tool = (kind == "response_item") & part.isin("function_call", "custom_tool_call") & (F.coalesce("p.name", F.lit("")) != "")
    event = (kind == "event_msg") & part.isin(*ROLLOUT_EVENTS)
    role = F.when(spoken, F.col("p.role")).when(tool, "tool").when(event, "event")
    text = F.when(spoken, content_text(F.col("p.content"))).when(tool, F.col("p.name")).when(event, part)
    return assemble(_messages(rows, role, text, F.when(kind == "session_meta", F.coalesce("p.id", "p.session_id")), F.lit(None).cast("string"), broken))


def read_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """Session JSONL: user turns that aren't meta or markup, assistant texts, an optional title for short questions."""
    schema = "type string, isMeta boolean, aiTitle string, summary string, sessionId string, message string"
    rows = complete_lines(spark, path).withColumn("r", F.from_json("line", schema)).withColumn("m", F.from_json("r.message", "role string, content string"))
    kind = F.col("r.type")
    user = (kind == "user") & (F.col("m.role") == "user") & ~F.coalesce("r.isMeta", F.lit(False))
    text = content_text(F.col("m.content"))
    said = F.when(user & ~F.startswith(text, F.lit("<")), text).when((kind == "assistant") & (F.col("m.role") == "assistant"), text)
    title = F.when(kind.isin("ai-title", "summary"), F.coalesce("r.aiTitle", "r.summary"))
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    messages = _messages(rows, kind, said, F.coalesce("r.sessionId", name), F.lit(None).cast("string"), F.coalesce(F.col("r.type").isNull(), F.lit(True)))
    titles = rows.filter(title.isNotNull()).groupBy("file").agg(F.min_by(title, F.col("place")).alias("title"))
    out = assemble(messages).join(titles.hint("merge"), "file", "left")
    return out.withColumn("problem_desc", F.when((F.length("problem_desc") < 15) & F.col("title").isNotNull(), F.substring("title", 1, 200)).otherwise(F.col("problem_desc"))).drop("title")


def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file with sessionId, summary and messages; model turns are the assistant's, a summary is the title."""
    message = "struct<type:string,role:string,content:string>"
    whole = files(spark, path).withColumn("d", F.from_json("body", f"sessionId string, summary string, messages array<{message}>"))
    rows = whole.select("file", "d.sessionId", "d.summary", F.col("d.messages").isNull().alias("broken"), F.posexplode_outer("d.messages").alias("at", "m")).withColumn("place", F.coalesce("at", F.lit(0)))
    said = F.coalesce("m.type", "m.role")
    role = F.when(said.isin("model", "gemini", "assistant"), "assistant").when(said == "user", "user")
    text = F.when(role.isNotNull(), content_text(F.col("m.content")))
    return assemble(_messages(rows, role, text, F.col("sessionId"), F.nullif("summary", F.lit("")), F.col("broken")))


def read_task_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file, in a folder named by its task; what follows <environment_details> in a text is dropped."""
    whole = files(spark, path).withColumn("d", F.from_json("body", "array<struct<role:string,content:string>>"))
    rows = whole.select("file", F.col("d").isNull().alias("broken"), F.posexplode_outer("d").alias("at", "m")).withColumn("place", F.coalesce("at", F.lit(0)))
    spoken = F.col("m.role").isin("user", "assistant")
    text = F.when(spoken, F.trim(F.substring_index(content_text(F.col("m.content")), "<environment_details>", 1)))
    return assemble(_messages(rows, F.col("m.role"), text, F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), F.lit(None).cast("string"), F.col("broken")))


def chat_exports(rows: DataFrame) -> DataFrame:
    """Sessions of exported key/value rows (workspace, key, value): a list is a session per item, an object one session."""
    chats = rows.filter(F.col("key").rlike(CHAT_KEYS))
    item = "struct<role:string,content:string,text:string>"
    listed = F.from_json("value", f"array<struct<messages:array<{item}>,text:string>>")
    single = F.from_json("value", f"conversations array<{item}>, messages array<{item}>, prompts array<{item}>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    many = chats.filter(is_list).select("workspace", "key", F.posexplode(listed).alias("n", "x")).select("workspace", "key", "n", F.coalesce("x.messages", F.array(F.struct(F.lit("user").alias("role"), F.col("x.text").alias("content"), F.lit(None).cast("string").alias("text")))).alias("messages"))
    one = chats.filter(~is_list).withColumn("x", single).select("workspace", "key", F.lit(0).alias("n"), F.coalesce("x.conversations", "x.messages", "x.prompts").alias("messages"))
    turns = many.unionByName(one).select(F.concat_ws("/", "workspace", "key", "n").alias("file"), F.posexplode("messages").alias("place", "m"))
    return assemble(_messages(turns, F.coalesce("m.role", F.lit("user")), content_text(F.coalesce("m.content", "m.text")), F.col("file"), F.lit(None).cast("string"), F.lit(False)))


def read_sessions_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat session files (a JSON array of sessions); a missing context is an empty envelope."""
    rows = spark.read.schema(schemas.SESSION).json(path, multiLine=True)
    return rows.withColumn("context", F.coalesce("context", F.lit("{}"))).fillna("", ["source", "raw_content", "problem_desc", "code_snippets", "conclusion"])

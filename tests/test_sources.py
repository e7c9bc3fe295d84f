"""Chat logs in several layouts, snapshots and redaction."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from engram.functions import context as C
from engram.functions import text as T
from engram.sources import chatlogs, snapshots


def _rows(df):
    return {r["external_id"]: r for r in df.collect()}


def test_rollouts_keep_order_tools_and_events_and_leave_the_open_line(spark, tmp_path):
    rec = [
        {"type": "session_meta", "payload": {"id": "s1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "why does it fail, token = abc123"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "fixed"}]}},
        {"type": "event_msg", "payload": {"type": "task_complete"}},
        {"type": "event_msg", "payload": "text"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rec)) + "\n" + '{"type": "response_item", "payl')
    row = _rows(chatlogs.read_rollouts(spark, str(tmp_path)))["s1"]
    assert row["raw_content"] == "[user] why does it fail, [REDACTED]\n[tool] shell\n[assistant] fixed\n[event] task_complete"
    assert (row["problem_desc"], row["conclusion"], row["n_invalid"], row["usable"]) == ("why does it fail, [REDACTED]", "fixed", 1, True)


def test_session_logs_use_titles_for_short_questions(spark, tmp_path):
    rec = [
        {"type": "summary", "summary": "A long enough title"},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "message": {"role": "user", "content": "<command-name>x</command-name>"}},
        {"type": "user", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "hello"}, {"type": "tool_use"}]}},
    ]
    (tmp_path / "s9.jsonl").write_text("\n".join(map(json.dumps, rec)) + "\nnot json\n")
    row = _rows(chatlogs.read_session_logs(spark, str(tmp_path)))["s9"]
    assert row["raw_content"] == "[user] hi\n[assistant] hello"
    assert (row["problem_desc"], row["conclusion"], row["n_invalid"]) == ("A long enough title", "hello", 1)


def test_chat_and_task_json(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.json").write_text(json.dumps({"sessionId": "g1", "summary": "sum", "messages": [{"type": "user", "content": "q"}, {"type": "gemini", "content": "a"}, {"type": "info", "content": "x"}]}, indent=1))
    row = _rows(chatlogs.read_chat_json(spark, str(tmp_path / "g")))["g1"]
    assert (row["raw_content"], row["problem_desc"], row["conclusion"]) == ("[user] q\n[assistant] a", "sum", "a")
    (tmp_path / "c" / "task7").mkdir(parents=True)
    (tmp_path / "c" / "task7" / "h.json").write_text(json.dumps([{"role": "user", "content": [{"type": "text", "text": "do it <environment_details>cwd</environment_details>"}]}, {"role": "assistant", "content": "ok"}]))
    row = _rows(chatlogs.read_task_json(spark, str(tmp_path / "c" / "*")))["task7"]
    assert row["raw_content"] == "[user] do it\n[assistant] ok"


def test_exports_and_flat_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("w", "aiService.prompts", '[{"text":"first"},{"messages":[{"role":"user","content":"q"}]}]'), ("w", "x.aichat.y", '{"conversations":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), ("w", "other", "{}")], "workspace string, key string, value string")
    got = sorted(r["raw_content"] for r in chatlogs.chat_exports(rows).collect())
    assert got == ["[user] a\n[assistant] b", "[user] first", "[user] q"]
    (tmp_path / "f.json").write_text(json.dumps([{"source": "s", "raw_content": "r", "problem_desc": "p", "conclusion": "c"}]))
    assert chatlogs.read_sessions_json(spark, str(tmp_path)).first()["context"] == "{}"


def test_snapshots_move_on_and_old_ones_stay(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert snapshots.write(spark.range(3), at) == 1
    assert snapshots.write(spark.range(5), at) == 2
    assert (snapshots.read(spark, at).count(), snapshots.read(spark, at, 1).count()) == (5, 3)


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    key = b"k" * 32
    got = spark.range(1).select(C.keyed_hash(F.lit("väl"), "ns", key).alias("h")).first()["h"]
    assert got == hmac.new(key, "ns\0väl".encode(), hashlib.sha256).hexdigest()


def test_terms(spark):
    row = spark.createDataFrame([("检索增强生成 abc abc Straße x_1",)], "t string").select(T.lexical_terms(F.col("t")).alias("a"), T.rerank_terms(F.col("t")).alias("b")).first()
    assert row["a"] == ["检索增强生成", "检索", "索增", "增强", "强生", "生成", "abc", "strasse"]
    assert sorted(row["b"]) == sorted(["检索", "索增", "增强", "强生", "生成", "abc", "strasse", "x_1"])

"""Files that grow, that are written anew, and that go, between polls."""

from __future__ import annotations

import json
import os

import pytest

from engram.sources import chatlogs, snapshots
from engram.streaming import watch


def record(role, text):
    return json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": text}}) + "\n"


META = json.dumps({"type": "session_meta", "payload": {"id": "s1"}}) + "\n"


def grow(path, text, at):
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)
    os.utime(path, (at, at))


def test_a_file_that_grows_twice_with_a_cut_line(spark, tmp_path):
    logs, root = tmp_path / "logs", f"file://{tmp_path}/store"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    parts = [META + record("user", "Frage mit ü?"), record("assistant", "first"), record("user", "more"), record("assistant", "last ß")]
    whole = "".join(parts)
    cut = len(parts[0]) + 12  # within the second record
    grow(a, whole[:cut], 1_000)
    grow(b, META.replace("s1", "s2") + record("user", "other"), 1_000)
    first = watch.poll(spark, str(logs), root)
    assert first.number == 1
    assert watch.poll(spark, str(logs), root) is None  # nothing has changed
    got = chatlogs.rollout_sessions(watch.lines(spark, root)).collect()
    assert {r["external_id"]: r["raw_content"] for r in got} == {"s1": "[user] Frage mit ü?", "s2": "[user] other"}
    grow(a, whole[cut:-5], 2_000)
    second = watch.poll(spark, str(logs), root)
    got = chatlogs.rollout_sessions(watch.lines(spark, root, second, first)).collect()
    assert [(r["external_id"], r["raw_content"]) for r in got] == [("s1", "[user] Frage mit ü?\n[assistant] first\n[user] more")]
    grow(a, whole[-5:], 3_000)
    third = watch.poll(spark, str(logs), root)
    sessions = {r["external_id"]: r["raw_content"] for r in chatlogs.rollout_sessions(watch.lines(spark, root)).collect()}
    assert sessions == {r["external_id"]: r["raw_content"] for r in chatlogs.read_rollouts(spark, str(logs)).collect()}
    added = snapshots.log(spark, root, "lines", watch.LINES).filter("file like '%a.jsonl'").groupBy("state").count().collect()
    assert sorted((r["state"], r["count"]) for r in added) == [(1, 2), (2, 2), (3, 1)]  # each record was read once
    files = {r["file"].rsplit("/", 1)[1]: r for r in snapshots.table(spark, root, "files", third).collect()}
    assert (files["a.jsonl"]["records"], files["a.jsonl"]["consumed"], files["a.jsonl"]["epoch"]) == (5, len(whole.encode()), 0)
    # readers of the state before still see it
    assert watch.lines(spark, root, first).count() == 4


def test_rewritten_and_missing_files(spark, tmp_path):
    logs, root = tmp_path / "logs", f"file://{tmp_path}/store"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    grow(a, META + record("user", "old"), 1_000)
    grow(b, record("user", "b"), 1_000)
    watch.poll(spark, str(logs), root)
    a.write_text(META + record("user", "written anew and longer than before"))
    os.utime(a, (2_000, 2_000))
    b.unlink()
    state = watch.poll(spark, str(logs), root)
    # what a file said stays when it is gone
    assert sorted(r["raw_content"] for r in chatlogs.rollout_sessions(watch.lines(spark, root)).collect()) == ["[user] b", "[user] written anew and longer than before"]
    files = {r["file"].rsplit("/", 1)[1]: (r["epoch"], r["present"]) for r in snapshots.table(spark, root, "files", state).collect()}
    assert files == {"a.jsonl": (1, True), "b.jsonl": (0, False)}
    assert watch.poll(spark, str(logs), root) is None
    # a touched file without new lines, and one that comes back with other content; an empty one isn't there yet
    grow(logs / "c.jsonl", "", 3_000)
    os.utime(a, (3_000, 3_000))
    grow(b, "x\n", 3_000)
    state = watch.poll(spark, str(logs), root)
    files = {r["file"].rsplit("/", 1)[1]: (r["epoch"], r["present"], r["records"]) for r in snapshots.table(spark, root, "files", state).collect()}
    assert files == {"a.jsonl": (1, True, 2), "b.jsonl": (1, True, 1)}


def test_an_interrupted_poll_is_made_again(spark, tmp_path, monkeypatch):
    logs, root = tmp_path / "logs", f"file://{tmp_path}/store"
    logs.mkdir()
    grow(logs / "a.jsonl", META + record("user", "one"), 1_000)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_point", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            watch.poll(spark, str(logs), root)
    assert snapshots.table(spark, root, "files") is None
    seen = []
    assert watch.watch(spark, str(logs), root, lambda before, after: seen.append((before.number, after.number)), polls=2, seconds=0) == 1
    assert seen == [(0, 1)] and watch.lines(spark, root).count() == 2

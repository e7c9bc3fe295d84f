"""The full cycle against one session after another, stopped anywhere; stateful streams against their batch forms."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import evaluation
from engram.params import DEFAULTS
from engram.plans import iterative_queries, views
from engram.sources import snapshots
from engram.streaming import cycle, jobs

DATA = "/root/testdata/sf0.001"
SCHEMA = "session_id long, problem_desc string, conclusion string"
FIRST = [(1, "alpha beta gamma delta", "one two three four"), (2, "other words entirely here", "no overlap at all"), (3, "Alpha Beta Gamma Delta", "one two three four five"), (4, None, ""), (5, "...", "!!!")]
SECOND = [(6, "alpha beta gamma delta", "one two three four"), (7, "alpha beta gamma", "one two three seven"), (8, "wholly new things", "to be said"), (6, "alpha beta gamma delta", "one two three four"), (2, "other words entirely here", "no overlap at all")]


def folder(spark, tmp_path, *batches):
    """Files of a batch each, in order of time."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").iterdir():
            if f.suffix == ".parquet" and f.name not in folder.seen:
                folder.seen.add(f.name)
                os.utime(f, (1000 + i, 1000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


folder.seen = set()


def contents(spark, root, at=None):
    out = {n: snapshots.table(spark, root, n, at) for n in ("stories", "edges", "sessions")}
    out["events"] = snapshots.log(spark, root, "events", cycle.EVENTS, at).drop("state")
    return {n: None if df is None else sorted(map(repr, (r.asDict(recursive=True) for r in df.collect()))) for n, df in out.items()}


def test_sessions_become_stories_in_order(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    params = dataclasses.replace(DEFAULTS, sim_low=0.1)
    cycle.run(folder(spark, tmp_path, FIRST, SECOND), root, f"{tmp_path}/state", params).start().awaitTermination()
    stories = {r["story_id"]: r for r in snapshots.table(spark, root, "stories").collect()}
    assert set(stories) == {1, 2, 5, 7, 8} or set(stories) == {1, 2, 5, 8}
    one = stories[1]
    assert one["session_ids"][:3] == [1, 3, 6] and one["version"] == len(one["session_ids"])
    assert one["sources"][:2] == ["session:1", "session:3"] and one["problem"].startswith("alpha beta gamma delta\n\nAlpha Beta Gamma Delta")
    assert stories[5]["embedding"] is None and stories[5]["version"] == 1 and stories[2]["session_ids"] == [2]
    events = [tuple(r)[:5] for r in snapshots.log(spark, root, "events", cycle.EVENTS).filter("entity_id = 1").orderBy("version").collect()]
    assert [e[2:4] for e in events] == [(i, i + 1) for i in range(len(events))] and [e[1] for e in events][0] == "create"
    assert [e[4] for e in events] == one["session_ids"] and events[2][1] == "update"  # an exact copy adds only its session
    status = {r["session_id"]: r["status"] for r in snapshots.table(spark, root, "sessions").collect()}
    assert status == dict.fromkeys(range(1, 9), "processed")
    edges = snapshots.table(spark, root, "edges").collect()
    assert all(r["source_id"] < r["target_id"] and r["provenance"] == {"by": "cycle"} for r in edges)
    # nothing new: nothing moves
    before = snapshots.state(spark, root)
    cycle.run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/state", params).start().awaitTermination()
    assert snapshots.state(spark, root) == before


@pytest.mark.parametrize("stop", ["edges", "pointer"])
def test_a_stop_between_two_tables_shows_none_of_them(spark, tmp_path, monkeypatch, stop):
    batches = FIRST[:3], SECOND[:2]
    whole = f"file://{tmp_path}/whole"
    plain = tmp_path / "plain"
    plain.mkdir()
    cycle.run(folder(spark, plain, *batches), whole, f"{plain}/state").start().awaitTermination()
    root = f"file://{tmp_path}/store"
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{plain}/in")
    write, point = snapshots._write, snapshots._point

    def broken_write(df, path):
        if f"/{stop}/" in path and path.endswith("=2"):
            raise OSError("stopped")
        write(df, path)

    def broken_point(spark_, root_, to, logs):
        if stop == "pointer" and to.number == 2:
            raise OSError("stopped")
        return point(spark_, root_, to, logs)

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_write", broken_write)
        m.setattr(snapshots, "_point", broken_point)
        with pytest.raises(Exception, match="stopped"):
            cycle.run(source(), root, f"{tmp_path}/state").start().awaitTermination()
    first = snapshots.state(spark, whole, 1)
    assert contents(spark, root) == contents(spark, whole, first) and snapshots.state(spark, root).number == 1
    cycle.run(source(), root, f"{tmp_path}/state").start().awaitTermination()
    assert contents(spark, root) == contents(spark, whole) and snapshots.state(spark, root).number == 2


def test_transcripts_whatever_the_order(spark, tmp_path):
    """Batches that come late or twice in one, long and short lines, caps that cut within a line: always the batch form."""
    rows = []
    for s in range(6):
        n = (1, 3, 8, 30, 60, 60)[s]
        rows += [(s, p, ("user", "assistant", "tool")[p % 3], None if p % 11 == 5 else f"{p}:" + "xé" * ((p * 7 + s) % 23)) for p in range(n)]
    rows += [(2, 4, "user", "again"), (2, 4, "user", "again")]
    schema = "session_id long, place long, role string, text string"
    (tmp_path / "in").mkdir()
    for i in (2, 0, 1):  # the last third comes first
        part = [r for k, r in enumerate(rows) if r[1] % 3 == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for cap in (40, 300, 100_000):
        out = f"{tmp_path}/out{cap}"
        stream = jobs.transcripts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), cap)
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state{cap}").trigger(availableNow=True).foreachBatch(lambda b, n, out=out: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
        got = spark.read.parquet(out).groupBy("session_id").agg(F.max_by("raw_content", "batch").alias("t"), F.max_by("conclusion", "batch").alias("c"))
        table = spark.createDataFrame(rows, schema).filter("text <> ''")
        lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))))
        want = table.groupBy("session_id").agg(T.bounded(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), cap).alias("t"), F.coalesce(F.substring(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("place"))), 1, 300), F.lit("")).alias("c"))
        assert {r["session_id"]: (r["t"], r["c"]) for r in got.collect()} == {r["session_id"]: (r["t"], r["c"]) for r in want.collect()}


def test_a_session_holds_little_more_than_the_cap():
    p = jobs.Transcript(100)
    held, chars = {}, 0
    for i in range(500):
        line = f"[user] {i}" + "x" * (i % 9)
        held[i, line] = 1
        chars += len(line) + 1
        held = p._shown(held, chars)
        assert sum(len(k[1]) + 1 for k in held) <= max(100 + 20, 2 * (50 + 20))
    assert min(held)[0] == 0 and max(held)[0] == 499


def test_rolling_diagnostics_keep_the_last_rows_only(spark, tmp_path):
    rows = views.frame(spark, DATA, "diagnostics").select("request_id", "ts", "mode", "total_ms", "embed_ms", "vector_ms")
    rows.repartitionByRange(4, "request_id").write.parquet(f"{tmp_path}/in")
    root, stages = f"file://{tmp_path}/store", ["total_ms", "embed_ms"]
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.diagnostics(source(), root, stages, f"{tmp_path}/state", n=20).start().awaitTermination()
    want = evaluation.percentiles(evaluation.last_n(rows, 20, "mode", "ts", "request_id"), stages, "mode")
    got = snapshots.table(spark, root, "summary")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r["count"] for r in snapshots.table(spark, root, "recent").groupBy("mode").count().collect()} == {20}
    assert snapshots.appended(spark, f"{root}/rows", "request_id long, ts timestamp").count() == rows.count()
    # a checkpoint that was lost: batches that are known count once
    at = snapshots.state(spark, root)
    jobs.diagnostics(source(), root, stages, f"{tmp_path}/other", n=20).start().awaitTermination()
    assert snapshots.state(spark, root) == at and snapshots.appended(spark, f"{root}/rows", "request_id long, ts timestamp").count() == rows.count()


def test_full_cycle_query(spark):
    out = iterative_queries.full_cycle(spark, DATA).collect()
    sessions = views.frame(spark, DATA, "sessions").filter("coalesce(problem_desc, '') <> '' or coalesce(conclusion, '') <> ''").count()
    assert sum(r["n_sessions"] for r in out) == sessions and all(r["version"] == r["n_events"] == r["last_version"] for r in out)

"""Consolidation within a batch, and streams against their batch forms."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from engram.operators import consolidate, events, graph
from engram.plans import iterative_queries, views
from engram.sources import snapshots
from engram.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_leaders_like_one_session_after_another(spark):
    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    near = defaultdict(set)
    for a, b in links:
        near[b].add(a)
    want, leads = {}, set()
    for i in range(60):
        own = sorted(near[i] & leads)
        want[i] = own[0] if own else i
        if not own:
            leads.add(i)
    got = consolidate.leaders(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(i,) for i in range(60)], "story_id long"))
    assert {r["story_id"]: r["leader"] for r in got.collect()} == want


def test_batch_consolidation_at_the_thresholds(spark):
    def with_cos(i, c):
        v = [0.0] * 8
        v[i], v[i + 1] = c, (1 - c * c) ** 0.5
        return v

    store = spark.createDataFrame([(1, with_cos(0, 1.0))], "story_id long, embedding array<double>")
    new = spark.createDataFrame([(10, with_cos(0, 0.921)), (11, with_cos(0, 0.919)), (12, with_cos(0, 0.851)), (13, with_cos(0, 0.849)), (14, with_cos(4, 1.0)), (15, with_cos(4, 0.9))], "query_id long, vector array<double>")
    got = {r["query_id"]: (r["branch"], r["target"]) for r in consolidate.batch_consolidation(new, store).collect()}
    assert got == {10: ("update", 1), 11: ("merge", 1), 12: ("merge", 1), 13: ("create", None), 14: ("create", None), 15: ("merge", 14)}


def test_stream_replay_ends_like_the_batch(spark):
    out = iterative_queries.stream_replay(spark, DATA)
    log = views.frame(spark, DATA, "memory_events")
    alive = events.replay(log).filter("state = 'live'")
    last = out.join(events.tombstones(log).select("entity_id"), "entity_id", "left_anti").filter("outcome = 'accepted'").groupBy("entity_id").agg(F.max_by("version", "sequence").alias("version"))
    assert {tuple(r) for r in last.select("entity_id", "version").collect()} == {tuple(r) for r in alive.select("entity_id", "version").collect()}
    clash = out.join(events.tombstones(log).select("entity_id"), "entity_id", "left_anti").filter("outcome = 'conflict'").select("sequence")
    assert {r[0] for r in clash.collect()} == {r["sequence"] for r in events.conflicts(log).collect()}


def test_feedback_stream_counts_a_batch_once(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "semantic", 0.5, False), (1, 3, "co_recall", 0.1, True)], "source_id long, target_id long, edge_type string, weight double, deleted boolean")
    lists = spark.createDataFrame([("l1", 1), ("l1", 2), ("l1", 3), ("l2", 1), ("l2", 2)], "list_id string, story_id long")
    active = spark.createDataFrame([(1,), (2,), (3,)], "story_id long")
    want = {tuple(r) for r in graph.feedback(edges, lists, ["list_id"], active).select("source_id", "target_id", "edge_type", F.round("weight", 6), "deleted").collect()}
    assert want == {(1, 2, "semantic", 0.7, False), (1, 3, "co_recall", 0.1, False), (1, 2, "co_recall", 0.2, False), (2, 3, "co_recall", 0.1, False)}
    table = f"file://{tmp_path}/edges"
    snapshots.write(edges, table)
    lists.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.feedback(spark.readStream.schema(lists.schema).parquet(f"{tmp_path}/in"), table, active, f"{tmp_path}/state").start().awaitTermination()
    got = {tuple(r) for r in snapshots.read(spark, table).select("source_id", "target_id", "edge_type", F.round("weight", 6), "deleted").collect()}
    assert got == want

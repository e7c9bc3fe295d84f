"""Registered governance, audit, event and evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import evaluation, events, governance
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import ctes

TODAY = "2024-07-01"


def _v(name: str):
    return lambda spark, sf_dir: views.frame(spark, sf_dir, name)


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories against a generation in which some are missing, some are new and some differ in one part or in two."""
    i = F.col("story_id")
    parent = views.frame(spark, sf_dir, "story_state").select("story_id", "parent_id")
    s = views.frame(spark, sf_dir, "stories").join(parent.hint("merge"), "story_id").select("story_id", "title", "content", "source", "parent_id", F.col("embedding").cast("array<float>").alias("embedding"))
    moved = s.filter(i % 31 != 0).withColumns({
        "title": F.when(i % 29 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "parent_id": F.when(i % 19 == 0, i).otherwise(F.col("parent_id")),
        "embedding": F.when(i % 23 == 0, F.reverse("embedding")).otherwise(F.col("embedding")),
    })
    new = moved.unionByName(s.filter(i % 37 == 0).withColumn("story_id", i + 1000000))
    out = governance.reconcile(s, new, "story_id", {"content": ("title", "content"), "relations": ("source", "parent_id"), "vectors": ("embedding",)})
    return out.select("story_id", "state", F.array_join("parts", ",").alias("parts"))


_state, _edges, _events, _diag = _v("story_state"), _v("edges"), _v("memory_events"), _v("diagnostics")


#: Edges of all types, weighing half after 50 days without use.
_aged = _v("edges_aged")


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "query_pairs").select("query_id", F.col("query_id").alias("story_id"))


def access_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.access_decay(_state(spark, sf_dir), F.to_date(F.lit(TODAY))).withColumn("access_score", F.round("access_score", 6))


def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.archive_candidates(_state(spark, sf_dir), _aged(spark, sf_dir), F.to_date(F.lit(TODAY)))


def forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access decay, then archive by the decayed counts; the edges as they are afterwards."""
    today = F.to_date(F.lit(TODAY))
    state = _state(spark, sf_dir)
    decayed = governance.access_decay(state, today, 10.0).select("story_id", "new_count")
    state = state.join(decayed.hint("merge"), "story_id").withColumn("access_count", F.col("new_count")).drop("new_count")
    _, edges, _ = governance.archive(state, _aged(spark, sf_dir), today)
    return edges.select("edge_id", "deleted")


def heaviest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.heaviest_edge(_state(spark, sf_dir), _edges(spark, sf_dir))


def tombstone_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir).select("story_id", "deleted", "no_vector", F.lit("ready").alias("embedding_status"), F.lit(1).cast("long").alias("version"))
    return governance.tombstones(state, state.filter("story_id % 3 = 0"))


def story_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = views.frame(spark, sf_dir, "sessions").withColumn("status", F.when(F.col("conv_id") % 3 == 0, "pending").otherwise("processed"))
    return governance.story_stats(_state(spark, sf_dir), sessions, _edges(spark, sf_dir))


def vector_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.vector_consistency(_state(spark, sf_dir), views.frame(spark, sf_dir, "vector_ids"))


def vector_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.repair_plan(_state(spark, sf_dir), views.frame(spark, sf_dir, "vector_ids"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stories(spark, sf_dir).select("story_id", F.md5(F.encode("content", "UTF-8")).alias("content_hash"), (F.col("story_id") % 41 != 0).alias("active"))


def backfill_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.backfill_pending(_hashed(spark, sf_dir), views.frame(spark, sf_dir, "shadow"), {"model": "m1", "dimension": 64})


def backfill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.backfill_gate(_hashed(spark, sf_dir), views.frame(spark, sf_dir, "shadow"))


def referential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir).withColumn("parent_id", F.when(F.col("story_id") % 50 == 1, F.col("story_id") + 5000000).otherwise(F.col("parent_id")))
    edges = _edges(spark, sf_dir).withColumn("target_id", F.when(F.col("edge_id") % 101 == 0, F.col("target_id") + 5000000).otherwise(F.col("target_id")))
    sessions = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session_id")).distinct()
    return governance.referential_audit(state, edges, state.select("story_id", F.col("story_id").alias("session_id")), sessions)


def generation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    return governance.generation_diff(orders, orders.filter("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))))


def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.session_upsert(views.frame(spark, sf_dir, "sessions"), views.frame(spark, sf_dir, "sessions_incoming"), "conv_id", ["problem_desc", "conclusion"])


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.manifest_diff(views.frame(spark, sf_dir, "files_old"), views.frame(spark, sf_dir, "files_new"))


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: files and what becomes of them, ok or degraded."""
    state = manifest_diff(spark, sf_dir).withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return state.groupBy("host").agg(F.count("*").alias("files"), F.count_if(F.col("state") == "new").alias("imported"), F.count_if(F.col("state").isin("appended", "rewritten", "reparse")).alias("updated"), F.count_if(F.col("state") == "unchanged").alias("skipped"), F.when(F.count_if(F.col("state") == "degraded") > 0, "degraded").otherwise("ok").alias("status"))


def dimension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"))
    return governance.dimension_rollup(rows, "user_id", "event_id", ["kind", "props"])


def revision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.revision_gaps(_events(spark, sf_dir).filter("version % 7 <> 0").select("entity_id", "version").distinct())


def event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.schema_check(_events(spark, sf_dir), ("create", "update", "merge", "delete"))


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replay(_events(spark, sf_dir))


def event_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.conflicts(_events(spark, sf_dir))


def event_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.ignored(_events(spark, sf_dir)).select("entity_id", "sequence")


def tombstone_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tombstones(_events(spark, sf_dir))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    return events.history(log, log.filter("operation = 'create'").select("entity_id")).select("entity_id", "sequence", "version", "before")


def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.recall_metrics(R.hybrid(spark, sf_dir).select("query_id", "story_id", "rank"), _qrels(spark, sf_dir))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def recall_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = recall_metrics(spark, sf_dir).join(views.frame(spark, sf_dir, "query_pairs").select("query_id", "lang").hint("merge"), "query_id")
    out = evaluation.means(metrics, "lang", ["recall_3", "mrr"])
    return out.select("lang", F.round("recall_3", 5).alias("recall_3"), F.round("mrr", 5).alias("mrr"), "n")


THRESHOLDS = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = views.queries(spark, sf_dir), R.stories(spark, sf_dir)
    out = evaluation.threshold_sweep(R.fusion.vector_lane(q, s, 3, 0.0), _qrels(spark, sf_dir), THRESHOLDS)
    return out.select("threshold", F.round("recall", 6).alias("recall"), F.round("returned", 6).alias("returned"))


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = views.queries(spark, sf_dir), R.stories(spark, sf_dir)
    first = R.fusion.vector_lane(q, s, 1, 0.0)
    wanted = views.frame(spark, sf_dir, "query_pairs").select("query_id", F.when(F.col("share") == 0.25, "update").when(F.col("share") == 0.5, "merge").otherwise("create").alias("expected"))
    return first.join(wanted.hint("merge"), "query_id")


def branch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.branch_accuracy(_branches(spark, sf_dir).withColumn("actual", evaluation.branch(F.col("similarity"), 0.85, 0.92)))
    return out.withColumn("accuracy", F.round("accuracy", 6))


def branch_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the branch at seven thresholds for the same story."""
    rows = _branches(spark, sf_dir).withColumn("high", F.explode(F.array(*(F.lit(x) for x in (0.76, 0.79, 0.82, 0.85, 0.88, 0.9, 0.91)))))
    return rows.groupBy("high").agg(F.round(F.avg((evaluation.branch(F.col("similarity"), F.col("high"), 0.92) == F.col("expected")).cast("double")), 6).alias("accuracy"))


def perf_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.percentiles(_diag(spark, sf_dir), ["total_ms", "embed_ms", "vector_ms"], "mode")


def perf_lower_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.lower_percentile(_diag(spark, sf_dir), "total_ms", 0.95, "mode")


def perf_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.ratios(_diag(spark, sf_dir), "mode")
    return out.select("mode", *(F.round(c, 6).alias(c) for c in ("cache_hit", "fallback", "degraded", "fallback_success")), "n")


def last_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.last_n(_diag(spark, sf_dir), 25, "mode", "ts", "request_id").select("mode", "request_id")


_S = f"WITH {ctes('story_state')}"
_SE = f"WITH {ctes('story_state', 'edges')}"
_M = f"WITH {ctes('memory_events')}"
_D = f"WITH {ctes('diagnostics')}"
_HEAVY = "heavy AS (SELECT s.story_id, coalesce(max(e.weight), 0) AS weight FROM story_state s LEFT JOIN (SELECT source_id AS id, weight FROM {0} WHERE NOT deleted UNION ALL SELECT target_id, weight FROM {0} WHERE NOT deleted) e ON e.id = s.story_id GROUP BY s.story_id)"
_REPLAY = f"""WITH RECURSIVE {ctes('memory_events')}, gone AS (SELECT entity_id FROM memory_events WHERE operation = 'delete'),
live AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY sequence) AS i FROM memory_events WHERE entity_id NOT IN (SELECT entity_id FROM gone)),
chain AS (SELECT entity_id, i, sequence, 0::BIGINT AS expected, base_version, CASE WHEN base_version = 0 THEN version ELSE 0 END::BIGINT AS now FROM live WHERE i = 1
    UNION ALL SELECT l.entity_id, l.i, l.sequence, c.now, l.base_version, CASE WHEN l.base_version = c.now THEN l.version ELSE c.now END::BIGINT FROM chain c JOIN live l ON l.entity_id = c.entity_id AND l.i = c.i + 1)"""
_METRICS = f"""WITH {R._PAIRS}, {R.FUSED}, per AS (SELECT query_id, count(*) AS n, min(CASE WHEN story_id = query_id THEN rank END) AS first FROM fused GROUP BY query_id),
metrics AS (SELECT p.query_id, p.lang, {', '.join(f"round(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS recall_{k}, round(coalesce(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END / least(n, {k}), 0), 6)::DOUBLE AS precision_{k}" for k in (1, 3, 5))}, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr FROM query_pairs p LEFT JOIN per USING (query_id))"""

SQL = {
    "reconciliation": f"""WITH {ctes('stories', 'story_state')}, s AS (SELECT story_id, embedding IS NOT NULL AS has, parent_id, title IS NOT NULL AS named FROM stories JOIN (SELECT story_id, parent_id FROM story_state) USING (story_id)),
d AS (SELECT story_id, concat_ws(',', CASE WHEN story_id % 29 = 0 AND named THEN 'content' END, CASE WHEN story_id % 19 = 0 THEN 'relations' END, CASE WHEN story_id % 23 = 0 AND has THEN 'vectors' END) AS parts FROM s WHERE story_id % 31 <> 0)
SELECT story_id, 'missing' AS state, '' AS parts FROM s WHERE story_id % 31 = 0 UNION ALL SELECT story_id, 'changed', parts FROM d WHERE parts <> '' UNION ALL SELECT story_id + 1000000, 'added', '' FROM s WHERE story_id % 37 = 0""",
    "access_decay": f"""{_S}, aged AS (SELECT story_id, access_count, access_count * pow(0.5, greatest(0, date_diff('day', last_day, DATE '{TODAY}')) / 30.0) AS score FROM story_state)
SELECT story_id, round(score, 6) AS access_score, CAST(round_even(score, 0) AS BIGINT) AS new_count, CAST(round_even(score, 0) AS BIGINT) <> access_count AS changed FROM aged""",
    "archive_candidates": f"""WITH {ctes('story_state', 'edges_aged')}, {_HEAVY.format('edges_aged')}, active AS (SELECT * FROM story_state WHERE NOT deleted AND NOT archived)
SELECT story_id, weight FROM active JOIN heavy USING (story_id) WHERE access_count <= 0 AND date_diff('day', last_day, DATE '{TODAY}') >= 90 AND weight <= 0.25 AND story_id NOT IN (SELECT parent_id FROM active WHERE parent_id IS NOT NULL)""",
    "forget": f"""WITH {ctes('story_state', 'edges_aged')}, {_HEAVY.format('edges_aged')},
active AS (SELECT *, CAST(round_even(access_count * pow(0.5, greatest(0, date_diff('day', last_day, DATE '{TODAY}')) / 10.0), 0) AS BIGINT) AS now FROM story_state WHERE NOT deleted AND NOT archived),
gone AS (SELECT story_id FROM active JOIN heavy USING (story_id) WHERE now <= 0 AND date_diff('day', last_day, DATE '{TODAY}') >= 90 AND weight <= 0.25 AND story_id NOT IN (SELECT parent_id FROM active WHERE parent_id IS NOT NULL))
SELECT edge_id, deleted OR source_id IN (SELECT story_id FROM gone) OR target_id IN (SELECT story_id FROM gone) AS deleted FROM edges_aged""",
    "heaviest_edge": f"{_SE}, {_HEAVY.format('edges')} SELECT story_id, weight FROM heavy",
    "tombstone_stories": f"""{_S} SELECT story_id, no_vector OR (story_id % 3 = 0 AND NOT deleted) AS no_vector, deleted OR story_id % 3 = 0 AS deleted, CASE WHEN story_id % 3 = 0 AND NOT deleted THEN 'archived' ELSE 'ready' END AS embedding_status,
1 + (story_id % 3 = 0 AND NOT deleted)::BIGINT AS version FROM story_state""",
    "story_stats": f"""WITH {ctes('story_state', 'edges', 'sessions')} SELECT 'active_stories' AS metric, count(*) FILTER (WHERE NOT deleted AND NOT archived) AS n FROM story_state UNION ALL SELECT 'archived_stories', count(*) FILTER (WHERE archived) FROM story_state
UNION ALL SELECT 'root_stories', count(*) FILTER (WHERE NOT deleted AND NOT archived AND parent_id IS NULL) FROM story_state UNION ALL SELECT 'child_stories', count(*) FILTER (WHERE NOT deleted AND NOT archived AND parent_id IS NOT NULL) FROM story_state
UNION ALL SELECT 'tombstones', count(*) FILTER (WHERE deleted) FROM story_state UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'pending_sessions', count(*) FILTER (WHERE conv_id % 3 = 0) FROM sessions
UNION ALL SELECT 'processed_sessions', count(*) FILTER (WHERE conv_id % 3 <> 0) FROM sessions UNION ALL SELECT 'active_edges', count(*) FILTER (WHERE NOT deleted) FROM edges""",
    "vector_consistency": f"""WITH {ctes('story_state', 'vector_ids')}, active AS (SELECT story_id FROM story_state WHERE NOT deleted AND NOT archived AND NOT no_vector)
SELECT story_id, 'missing_vec' AS problem FROM active WHERE story_id NOT IN (SELECT story_id FROM vector_ids) UNION ALL SELECT DISTINCT story_id, 'orphan_vec' FROM vector_ids WHERE story_id NOT IN (SELECT story_id FROM active)""",
    "vector_repair": f"""WITH {ctes('story_state', 'vector_ids')}, active AS (SELECT story_id FROM story_state WHERE NOT deleted AND NOT archived AND NOT no_vector)
SELECT story_id, 'rebuild' AS action FROM active WHERE story_id NOT IN (SELECT story_id FROM vector_ids) UNION ALL SELECT DISTINCT story_id, 'clear' FROM vector_ids WHERE story_id NOT IN (SELECT story_id FROM active)""",
    "backfill_pending": f"WITH {ctes('stories', 'shadow')} SELECT s.story_id, md5(s.content) AS content_hash FROM stories s LEFT JOIN shadow h ON h.story_id = s.story_id AND h.status = 'ready' AND h.content_hash = md5(s.content) WHERE s.story_id % 41 <> 0 AND h.story_id IS NULL",
    "backfill_gate": f"""WITH {ctes('stories', 'shadow')}, j AS (SELECT h.status, h.dimension, coalesce(h.status = 'ready' AND h.content_hash = md5(s.content), false) AS ready FROM stories s LEFT JOIN shadow h USING (story_id) WHERE s.story_id % 41 <> 0)
SELECT count(*) AS n_active, count(*) FILTER (WHERE ready) AS n_ready, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(DISTINCT CASE WHEN ready THEN dimension END) AS n_dimensions, count(*) = count(*) FILTER (WHERE ready) AND count(DISTINCT CASE WHEN ready THEN dimension END) = 1 AS complete FROM j""",
    "referential_audit": f"""{_SE}, st AS (SELECT story_id, CASE WHEN story_id % 50 = 1 THEN story_id + 5000000 ELSE parent_id END AS parent_id FROM story_state), ed AS (SELECT edge_id, source_id, CASE WHEN edge_id % 101 = 0 THEN target_id + 5000000 ELSE target_id END AS target_id FROM edges)
SELECT 'parent' AS kind, story_id AS id FROM st WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT story_id FROM st) UNION ALL SELECT 'session', story_id FROM st WHERE story_id NOT IN (SELECT conv_id FROM conversations)
UNION ALL SELECT 'edge', edge_id FROM ed WHERE source_id NOT IN (SELECT story_id FROM st) OR target_id NOT IN (SELECT story_id FROM st)""",
    "generation_diff": """WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 17 <> 0)
SELECT *, 'old' AS side FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT *, 'new' FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)""",
    "session_upsert": f"""WITH {ctes('sessions', 'sessions_incoming')}, j AS (SELECT coalesce(o.conv_id, i.conv_id) AS conv_id, CASE WHEN o.conv_id IS NULL THEN 'created' WHEN i.conv_id IS NULL THEN 'absent' WHEN o.problem_desc IS NOT DISTINCT FROM i.problem_desc AND o.conclusion IS NOT DISTINCT FROM i.conclusion THEN 'unchanged' ELSE 'updated' END AS action,
CASE WHEN i.conv_id IS NULL THEN o.problem_desc ELSE i.problem_desc END AS problem_desc, CASE WHEN i.conv_id IS NULL THEN o.conclusion ELSE i.conclusion END AS conclusion FROM sessions o FULL JOIN sessions_incoming i ON o.conv_id = i.conv_id)
SELECT *, CASE WHEN action IN ('created', 'updated') THEN 'pending' ELSE 'processed' END AS status FROM j""",
    "manifest_diff": f"""WITH {ctes('files_old', 'files_new')} SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'degraded' WHEN n.adapter <> o.adapter THEN 'reparse'
WHEN n.digest = o.digest AND n.size = o.size AND n.mtime = o.mtime THEN 'unchanged' WHEN n.size > o.size THEN 'appended' ELSE 'rewritten' END AS state FROM files_old o FULL JOIN files_new n ON o.url = n.url""",
    "import_summary": f"""WITH {ctes('files_old', 'files_new')}, s AS (SELECT regexp_extract(coalesce(o.url, n.url), '://([^/]+)', 1) AS host, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'degraded' WHEN n.adapter <> o.adapter THEN 'reparse'
WHEN n.digest = o.digest AND n.size = o.size AND n.mtime = o.mtime THEN 'unchanged' WHEN n.size > o.size THEN 'appended' ELSE 'rewritten' END AS state FROM files_old o FULL JOIN files_new n ON o.url = n.url)
SELECT host, count(*) AS files, count(*) FILTER (WHERE state = 'new') AS imported, count(*) FILTER (WHERE state IN ('appended', 'rewritten', 'reparse')) AS updated, count(*) FILTER (WHERE state = 'unchanged') AS skipped, CASE WHEN count(*) FILTER (WHERE state = 'degraded') > 0 THEN 'degraded' ELSE 'ok' END AS status FROM s GROUP BY host""",
    "dimension_rollup": "SELECT user_id, arg_max(CASE WHEN event_type <> 'click' THEN event_type END, CASE WHEN event_type <> 'click' THEN event_id END) AS kind, arg_max(CASE WHEN event_id % 3 = 0 THEN props END, CASE WHEN event_id % 3 = 0 THEN event_id END) AS props FROM events GROUP BY user_id",
    "revision_gaps": f"{_M}, r AS (SELECT DISTINCT entity_id, version FROM memory_events WHERE version % 7 <> 0), w AS (SELECT *, lag(version) OVER (PARTITION BY entity_id ORDER BY version) AS before FROM r) SELECT * FROM w WHERE before IS NOT NULL AND version <> before + 1",
    "event_checks": f"""{_M} SELECT sequence, 'bad_operation' AS reason FROM memory_events WHERE operation NOT IN ('create', 'update', 'merge', 'delete') UNION ALL SELECT sequence, 'bad_version' FROM memory_events WHERE version <= base_version UNION ALL SELECT sequence, 'negative_base' FROM memory_events WHERE base_version < 0""",
    "event_replay": f"""{_REPLAY}, last AS (SELECT entity_id, arg_max(now, i) AS version, count(*) FILTER (WHERE expected = base_version) AS accepted FROM chain GROUP BY entity_id)
SELECT entity_id, version, 'live' AS state FROM last WHERE accepted > 0 UNION ALL SELECT entity_id, CAST(max(version) AS BIGINT), 'deleted' FROM memory_events WHERE operation = 'delete' GROUP BY entity_id""",
    "event_conflicts": f"{_REPLAY} SELECT entity_id, sequence, expected, CAST(base_version AS BIGINT) AS actual FROM chain WHERE expected <> base_version",
    "event_ignored": f"{_M} SELECT entity_id, sequence FROM memory_events WHERE operation <> 'delete' AND entity_id IN (SELECT entity_id FROM memory_events WHERE operation = 'delete')",
    "tombstone_projection": f"{_M} SELECT entity_id, version, sequence FROM memory_events WHERE operation = 'delete' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, sequence DESC) = 1",
    "event_history": f"{_M} SELECT entity_id, sequence, version, lag(version) OVER (PARTITION BY entity_id ORDER BY sequence) AS before FROM memory_events WHERE entity_id IN (SELECT entity_id FROM memory_events WHERE operation = 'create')",
    "recall_metrics": f"{_METRICS} SELECT * EXCLUDE (lang) FROM metrics",
    "recall_by_language": f"{_METRICS} SELECT lang, round(avg(recall_3), 5) AS recall_3, round(avg(mrr), 5) AS mrr, count(*) AS n FROM metrics GROUP BY ROLLUP (lang)",
    "threshold_sweep": f"""WITH {R._PAIRS}, {R.VECTOR_LANE}, grid AS (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold), n AS (SELECT count(*) AS n FROM query_pairs)
SELECT threshold, round(count(*) FILTER (WHERE story_id = query_id) / any_value(n), 6) AS recall, round(count(query_id) / any_value(n), 6) AS returned FROM grid CROSS JOIN n LEFT JOIN (SELECT * FROM vector_lane WHERE rank <= 3) l ON similarity >= threshold GROUP BY threshold""",
    "branch_accuracy": f"""WITH {R._PAIRS}, {R.VECTOR_LANE}, b AS (SELECT CASE WHEN similarity >= 0.92 THEN 'update' WHEN similarity >= 0.85 THEN 'merge' ELSE 'create' END AS actual, CASE share WHEN 0.25 THEN 'update' WHEN 0.5 THEN 'merge' ELSE 'create' END AS expected FROM vector_lane JOIN query_pairs USING (query_id) WHERE rank = 1)
SELECT expected, round(avg((actual = expected)::INT), 6) AS accuracy, count(*) AS n FROM b GROUP BY ROLLUP (expected)""",
    "branch_sweep": f"""WITH {R._PAIRS}, {R.VECTOR_LANE}, grid AS (SELECT unnest([0.76, 0.79, 0.82, 0.85, 0.88, 0.9, 0.91])::DOUBLE AS high),
b AS (SELECT high, CASE WHEN similarity >= 0.92 THEN 'update' WHEN similarity >= high THEN 'merge' ELSE 'create' END = CASE share WHEN 0.25 THEN 'update' WHEN 0.5 THEN 'merge' ELSE 'create' END AS ok FROM vector_lane JOIN query_pairs USING (query_id), grid WHERE rank = 1)
SELECT high, round(avg(ok::INT), 6) AS accuracy FROM b GROUP BY high""",
    "perf_percentiles": f"""{_D}, long AS (SELECT mode, 'total_ms' AS stage, total_ms AS ms FROM diagnostics UNION ALL SELECT mode, 'embed_ms', embed_ms FROM diagnostics UNION ALL SELECT mode, 'vector_ms', vector_ms FROM diagnostics)
SELECT mode, stage, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99 FROM long GROUP BY mode, stage""",
    "perf_lower_percentile": f"{_D}, w AS (SELECT mode, total_ms, row_number() OVER (PARTITION BY mode ORDER BY total_ms) - 1 AS i, count(*) OVER (PARTITION BY mode) AS n FROM diagnostics) SELECT DISTINCT mode, total_ms FROM w WHERE i = floor((n - 1) * 0.95::DOUBLE)",
    "perf_ratios": f"""{_D} SELECT mode, round(avg(cache_hit::INT), 6) AS cache_hit, round(avg(fallback::INT), 6) AS fallback, round(avg(degraded::INT), 6) AS degraded, round(avg(CASE WHEN fallback THEN (NOT degraded)::INT END), 6) AS fallback_success, count(*) AS n FROM diagnostics GROUP BY mode""",
    "last_diagnostics": f"{_D} SELECT mode, request_id FROM diagnostics QUALIFY row_number() OVER (PARTITION BY mode ORDER BY ts DESC, request_id DESC) <= 25",
}

QUERIES = {name: globals()[name] for name in SQL}

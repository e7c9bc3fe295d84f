"""Registered queries on strategies, graph ranks and envelopes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import ablation, evaluation, fusion, graph, lexical
from engram.operators import envelopes as E
from engram.plans import graph_queries as G
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import ctes
from engram.sources.stage_tables import materialize

#: The mode whose latencies stand for a strategy's.
MODES = {"direct_vector": "fast", "hybrid": "fast", "hybrid_reranker": "auto", "hybrid_rewrite": "deep"}


def strategy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four strategies, hard where more than half of the query's vector is the neighbour's."""
    q, s = views.queries(spark, sf_dir), R.stories(spark, sf_dir)
    v = materialize(fusion.vector_lane(q, s, R.K, 0.5), "vector-lane")
    x = materialize(lexical.lexical_topk(q, s, R.K), "lexical-lane")
    hybrid = materialize(fusion.reciprocal_fusion(v, x, R.K), "hybrid")
    runs = {
        "direct_vector": v, "hybrid": hybrid,
        "hybrid_reranker": fusion.overlap_rerank(q, hybrid, s, 8), "hybrid_rewrite": R.merged_lanes(v, x),
    }
    cases = views.frame(spark, sf_dir, "query_pairs").select("query_id", F.col("query_id").alias("story_id"), (F.col("share") >= 0.8).alias("hard"))
    speed = evaluation.percentiles(views.frame(spark, sf_dir, "diagnostics"), ["total_ms"], "mode").select("mode", F.col("p95").alias("p95_ms"))
    mode = F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair))[F.col("strategy")]
    results = ablation.strategy_results(runs, cases).withColumn("mode", mode).join(speed.hint("merge"), "mode", "left").drop("mode")
    return ablation.strategy_gates(results, "direct_vector", ["hybrid_rewrite"])


def graph_vector_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are the heaviest passable neighbours of a query's own story."""
    edges, active = materialize(views.frame(spark, sf_dir, "edges"), "edges"), G._active(spark, sf_dir)
    hits = materialize(fusion.vector_lane(views.queries(spark, sf_dir), R.stories(spark, sf_dir), 5, 0.5), "hits")
    paths = graph.two_hop(hits.select("story_id").distinct(), edges)
    targets = graph.neighbors(edges, active).filter("place = 1").select(F.col("node").alias("query_id"), F.col("neighbor").alias("story_id"))
    asked = targets.join(views.frame(spark, sf_dir, "query_pairs").select("query_id").hint("merge"), "query_id", "left_semi")
    return ablation.graph_ranks(hits, paths, asked, 10)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of every story as different clients write them, brought into one form."""
    e = views.frame(spark, sf_dir, "environments")
    n, given = F.col("story_id"), lambda test, value: F.when(test, value)
    raw = F.to_json(F.struct(
        F.struct(
            F.when(n % 4 == 0, "claude_code").when(n % 4 == 1, "codex").when(n % 4 == 2, F.col("tool_type")).alias("type"), F.lit("1.2").alias("version"),
            F.when(n % 3 == 0, "hook").when(n % 3 == 1, "pipe").alias("integration_mode"),
        ).alias("tool"),
        F.struct(F.concat(F.lit("{"), F.upper(F.md5(F.encode(n.cast("string"), "UTF-8"))), F.lit("}")).alias("id"), F.coalesce("os_family", F.lit("")).alias("os_family"), F.col("arch").alias("arch")).alias("device"),
        F.struct(F.when(n % 2 == 0, "2024-03-01T10:00:00+02:00").otherwise("yesterday").alias("started_at"), given(n % 5 == 0, F.concat(F.lit("HMAC-SHA256:"), F.upper(F.sha2(F.encode(n.cast("string"), "UTF-8"), 256)))).alias("external_session_hash")).alias("session"),
        F.struct(F.concat(F.lit("/home/me/"), F.col("workspace_id"), F.lit("/My <Project>/")).alias("project_label"), given(n % 3 == 0, F.concat(F.lit("https://me@Host.org:443/"), F.col("workspace_id"), F.lit(".git"))).alias("repo_url")).alias("workspace"),
        F.struct(F.when(n % 2 == 0, F.col("runtime_kind")).otherwise("ssh").alias("kind"), given(n % 6 == 0, F.create_map(F.lit("python"), F.lit("3.13"))).alias("versions")).alias("runtime"),
        given(n % 7 == 0, F.lit("not an id")).alias("device_id"),
        F.create_map(F.lit("tool.type"), F.lit("detected"), F.lit("device.os_family"), F.lit("user_confirmed"), F.lit("device.arch"), F.lit("guessed")).alias("provenance"),
        F.lit("2024-03-01T08:30:00").alias("captured_at"),
    ))
    out = E.normalize(e.select("story_id", raw.alias("e")), "e", b"local key")
    leaves = ("tool.type", "tool.version", "tool.adapter", "tool.integration_mode", "device.id", "device.os_family", "device.arch", "session.started_at", "session.external_session_hash", "workspace.project_label", "workspace.repo_fingerprint", "runtime.kind", "captured_at")
    tags = ("tool.type", "tool.adapter", "device.id", "device.os_family", "device.arch", "runtime.kind")
    return out.select("story_id", *(F.col(f"e.{leaf}").alias(leaf.replace(".", "_")) for leaf in leaves), *(F.col("e.provenance")[t].alias(f"by_{t.replace('.', '_')}") for t in tags), F.size("e.provenance").alias("n_tags"), F.coalesce(F.col("e.runtime.versions")["python"], F.lit("")).alias("python"))


_RANKED = {
    "direct_vector": f"SELECT query_id, story_id, rank FROM vector_lane WHERE rank <= {R.K} AND similarity >= 0.5", "hybrid": "SELECT query_id, story_id, rank FROM fused",
    "hybrid_reranker": "SELECT query_id, story_id, rank FROM reranked", "hybrid_rewrite": "SELECT query_id, story_id, rank FROM rewritten",
}
_BODY = lambda name: R.SQL[name].split(R.FUSED, 1)[1].lstrip(", \n")


def _part(name: str, alias: str) -> str:
    """What a query adds to the fused lanes: its tables, and its last selection under a name."""
    tables, last = _BODY(name).rsplit("\nSELECT ", 1)
    return f"{tables}, {alias} AS (SELECT {last})"


_UUID = "regexp_replace(md5(story_id::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"
SQL = {
    "strategy_gates": f"""WITH {ctes('query_pairs', 'diagnostics')}, {R.FUSED}, {_part('rerank_overlap', 'reranked')}, {_part('transform_merge', 'rewritten')},
runs AS ({' UNION ALL '.join(f"SELECT '{name}' AS strategy, '{MODES[name]}' AS mode, * FROM ({text})" for name, text in _RANKED.items())}),
kinds AS (SELECT DISTINCT strategy, mode FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in MODES.items())}) t(strategy, mode)),
firsts AS (SELECT strategy, query_id, min(rank) AS first FROM runs WHERE story_id = query_id GROUP BY ALL),
scores AS (SELECT strategy, mode, share >= 0.8 AS hard, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS r, coalesce(1.0 / first, 0)::DOUBLE AS m FROM kinds CROSS JOIN query_pairs LEFT JOIN firsts USING (strategy, query_id)),
means AS (SELECT strategy, mode, round(avg(r), 6) AS recall_3, round(avg(m), 6) AS mrr, round(coalesce(avg(r) FILTER (WHERE hard), 0), 6) AS hard_recall_3, round(coalesce(avg(m) FILTER (WHERE hard), 0), 6) AS hard_mrr, count(*) AS n FROM scores GROUP BY ALL),
speed AS (SELECT mode, round(quantile_cont(total_ms, 0.95), 3) AS p95_ms FROM diagnostics GROUP BY mode), base AS (SELECT recall_3 AS r0, hard_recall_3 AS h0, hard_mrr AS m0 FROM means WHERE strategy = 'direct_vector'),
judged AS (SELECT m.* EXCLUDE (mode), p95_ms, CASE WHEN h0 >= 0.9 THEN round(hard_mrr - m0, 6) >= 0.05 ELSE round(hard_recall_3 - h0, 6) >= 0.1 END AS hard_quality_gain, round(recall_3 - r0, 6) >= -0.02 AS overall_non_regression,
    p95_ms <= CASE WHEN strategy = 'hybrid_rewrite' THEN 5000 ELSE 1000 END AS latency, true AS ground_truth_isolation, true AS online_latency_evidence FROM means m LEFT JOIN speed USING (mode), base),
told AS (SELECT *, strategy <> 'direct_vector' AND coalesce(hard_quality_gain AND overall_non_regression AND latency, false) AS eligible FROM judged)
SELECT *, row_number() OVER (ORDER BY eligible DESC, CASE WHEN NOT eligible THEN (strategy <> 'direct_vector')::INT END, hard_recall_3 DESC, hard_mrr DESC, recall_3 DESC, p95_ms, strategy) = 1 AS selected FROM told""",
    "graph_vector_ranks": f"""WITH {ctes('query_pairs', 'edges', 'story_state')}, {R.VECTOR_LANE}, {G._TWO_WAYS}, hits AS (SELECT query_id, story_id, similarity, rank FROM vector_lane WHERE rank <= 5 AND similarity >= 0.5),
steps AS (SELECT node, neighbor, weight * CASE edge_type WHEN 'semantic' THEN 0.85 WHEN 'temporal' THEN 0.80 WHEN 'causal' THEN 1.0 WHEN 'same_environment' THEN 0.90 WHEN 'parent_child' THEN 0.95 ELSE 1.0 END::DOUBLE
    * CASE WHEN edge_type = 'parent_child' AND direction = 'inbound' THEN 0.9 ELSE 1.0 END::DOUBLE AS step FROM passable),
hop1 AS (SELECT story_id AS seed, neighbor AS node, max(step) AS p FROM (SELECT DISTINCT story_id FROM hits) JOIN steps ON node = story_id WHERE neighbor <> story_id GROUP BY ALL),
hop2 AS (SELECT seed, neighbor AS node, max(p * step) AS p FROM hop1 JOIN steps USING (node) WHERE neighbor <> seed GROUP BY ALL),
paths AS (SELECT seed, node, max(score) AS score FROM (SELECT seed, node, round(p, 12) AS score FROM hop1 UNION ALL SELECT seed, node, round(p * 0.82::DOUBLE, 12) FROM hop2) GROUP BY ALL HAVING max(score) >= 0.55),
met AS (SELECT query_id, story_id, max(score) AS score FROM (SELECT query_id, story_id, similarity::DOUBLE AS score FROM hits UNION ALL SELECT query_id, node, round(similarity * score, 8) FROM hits h JOIN paths p ON p.seed = h.story_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, story_id) AS place FROM met),
targets AS (SELECT node AS query_id, neighbor AS story_id FROM passable WHERE node IN (SELECT story_id FROM active) AND node IN (SELECT query_id FROM query_pairs) QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id) = 1)
SELECT t.query_id, t.story_id, h.rank AS before, p.place AS after FROM targets t LEFT JOIN hits h ON h.query_id = t.query_id AND h.story_id = t.story_id LEFT JOIN placed p ON p.query_id = t.query_id AND p.story_id = t.story_id AND place <= 10""",
    "envelopes": f"""WITH {ctes('environments')} SELECT story_id, CASE story_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'other' END AS tool_type, '1.2' AS tool_version, NULL::VARCHAR AS tool_adapter,
CASE story_id % 3 WHEN 0 THEN 'hook' WHEN 1 THEN 'manual' END AS tool_integration_mode, CASE WHEN story_id % 7 <> 0 THEN {_UUID} END AS device_id, os_family AS device_os_family, arch AS device_arch,
CASE WHEN story_id % 2 = 0 THEN '2024-03-01T08:00:00Z' END AS session_started_at, CASE WHEN story_id % 5 = 0 THEN concat('hmac-sha256:', sha256(story_id::VARCHAR)) END AS session_external_session_hash, 'My -Project' AS workspace_project_label,
CASE WHEN story_id % 3 = 0 THEN concat('sha256:', sha256(concat('host.org/', lower(workspace_id)))) END AS workspace_repo_fingerprint,
CASE WHEN story_id % 2 = 1 THEN 'ssh' WHEN runtime_kind IN ('local', 'ci') THEN runtime_kind ELSE 'unknown' END AS runtime_kind, '2024-03-01T08:30:00Z' AS captured_at,
CASE WHEN story_id % 4 = 3 THEN 'unknown' ELSE 'detected' END AS by_tool_type, 'unknown' AS by_tool_adapter, CASE WHEN story_id % 7 = 0 THEN 'unknown' ELSE 'reported' END AS by_device_id, CASE WHEN os_family IS NULL THEN 'unknown' ELSE 'user_confirmed' END AS by_device_os_family,
'reported' AS by_device_arch, CASE WHEN story_id % 2 = 1 OR runtime_kind IN ('local', 'ci') THEN 'reported' ELSE 'unknown' END AS by_runtime_kind, 27 AS n_tags, CASE WHEN story_id % 6 = 0 THEN '3.13' ELSE '' END AS python FROM environments""",
}

QUERIES = {name: globals()[name] for name in SQL}

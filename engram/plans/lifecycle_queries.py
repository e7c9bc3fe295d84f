"""Registered revision, provenance and re-embedding queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import fusion, governance, lexical, lifecycle, stories
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import ctes


def revision_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.stories(spark, sf_dir).select("story_id", "lang", "source", "label", F.lit(1).cast("long").alias("version"))
    return lifecycle.revisions(s, ["source", "lang", "label"])


def baseline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.frame(spark, sf_dir, "memory_events")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("entity_id"))
    return lifecycle.baseline_events(people, log)


def event_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.frame(spark, sf_dir, "memory_events")
    known = views.frame(spark, sf_dir, "story_state").select(F.col("story_id").alias("entity_id"), "parent_id", F.array(F.col("story_id") + 1, F.col("story_id")).alias("session_ids"))
    sessions = views.frame(spark, sf_dir, "sessions").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("g"), "conv_id").alias("global_id"))
    return lifecycle.provenance(log, known, sessions).withColumn("sessions", F.array_join("sessions", ","))


def environment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") % 5).alias("session_id"), F.col("event_id").alias("captured"), "event_type")
    out = lifecycle.merge_environments(e, "user_id", "session_id", "captured", ["event_type"])
    return out.select("user_id", F.array_join(F.transform("environments", lambda x: F.concat_ws(":", x["session_id"].cast("string"), x["event_type"])), ",").alias("environments"))


def reembed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories whose shadow row is missing or stale, embedded again by the hashing vectoriser."""
    s = R.stories(spark, sf_dir).select("story_id", F.md5(F.encode("content", "UTF-8")).alias("content_hash"), (F.col("story_id") % 41 != 0).alias("active"), F.when(F.col("story_id") % 10 != 0, F.col("title")).otherwise(F.lit("")).alias("text"))
    pending = governance.backfill_pending(s, views.frame(spark, sf_dir, "shadow"), {"model": "m1", "dimension": 64}).join(s.select("story_id", "text").hint("merge"), "story_id")
    out = lifecycle.reembed(pending, lambda t: lifecycle.hashing_vector(T.rerank_terms(t), 64), 64)
    return out.select("story_id", "content_hash", "status", F.round(F.coalesce(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)), 6).alias("norm"))


def identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.frame(spark, sf_dir, "shadow").withColumn("model", F.when(F.col("story_id") % 23 == 0, "m0").otherwise(F.col("model")))
    return lifecycle.identity_mismatch(s, "m1", 64).withColumn("reasons", F.array_join("reasons", ","))


def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of queries whose vector is missing: the lexical lane alone, and the state of the result."""
    q = views.queries(spark, sf_dir).withColumn("vector", F.when(F.col("query_id") % 20 != 0, F.col("vector")))
    s = R.stories(spark, sf_dir)
    out = fusion.reciprocal_fusion(fusion.vector_lane(q, s, 20, 0.5), lexical.lexical_topk(q, s, 20), 3)
    best = q.select("query_id", F.col("vector").isNull().alias("degraded")).join(out.filter("rank = 1").select("query_id", "story_id", "lane").hint("merge"), "query_id", "left")
    return best.select("query_id", "degraded", "story_id", "lane", F.when(F.col("story_id").isNull(), "empty").when(F.col("degraded"), "degraded").otherwise("ok").alias("result_state"))


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expand_queries(views.queries(spark, sf_dir))


def transform_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.queries(spark, sf_dir).select("query_id", "text")
    made = q.filter("query_id % 30 <> 0").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("query_sha256"), F.upper("text").alias("output"))
    return lifecycle.attach_transforms(q, made)


def source_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.frame(spark, sf_dir, "stories").select("story_id", F.array(F.struct(F.when(F.col("story_id") % 2 == 0, F.col("story_id")).alias("session_id"), F.col("lang").alias("evidence")), F.struct(F.when(F.col("story_id") % 2 == 0, F.col("story_id")).alias("session_id"), F.col("lang").alias("evidence"))).alias("sources"), F.when(F.col("story_id") % 3 == 0, F.array("story_id")).otherwise(F.array("story_id", F.col("story_id") + 1)).alias("session_ids"))
    out = stories.normalize_sources(s)
    return out.select("story_id", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", F.coalesce(x["session_id"].cast("string"), F.lit("-")), F.coalesce(x["evidence"], F.lit("-")))), ",").alias("sources"))


SQL = {
    "revision_hashes": f"""WITH {ctes('stories')}, j AS (SELECT story_id, 1::BIGINT AS version, concat('{{', '"label":', coalesce(label::VARCHAR, 'null'), ',', '"lang":"', lang, '","source":"', source, '"}}') AS snapshot FROM stories) SELECT *, sha256(snapshot) AS snapshot_hash FROM j""",
    "baseline_events": f"WITH {ctes('memory_events')} SELECT DISTINCT c_custkey::BIGINT AS entity_id, 0::BIGINT AS base_version, 1::BIGINT AS version, 'create' AS operation FROM customer WHERE c_custkey NOT IN (SELECT entity_id FROM memory_events)",
    "event_provenance": f"""WITH {ctes('memory_events', 'story_state', 'sessions')} SELECT sequence, any_value(parent_id) AS parent_id, coalesce(string_agg('g' || conv_id, ',' ORDER BY conv_id), '') AS sessions
FROM memory_events m LEFT JOIN story_state s ON s.story_id = m.entity_id LEFT JOIN sessions c ON c.conv_id IN (s.story_id, s.story_id + 1) GROUP BY sequence""",
    "environment_union": "WITH e AS (SELECT user_id, event_id % 5 AS s, max(event_id) AS latest, arg_max(event_type, event_id) AS t FROM events GROUP BY ALL) SELECT user_id, string_agg(concat(s, ':', t), ',' ORDER BY latest) AS environments FROM e GROUP BY user_id",
    "reembed_status": f"""WITH {ctes('stories', 'shadow')}, p AS (SELECT s.story_id, md5(s.content) AS content_hash, regexp_matches(replace(lower(s.title), 'ß', 'ss'), '[a-z0-9_{T.CJK}]') AND s.story_id % 10 <> 0 AS ok FROM stories s LEFT JOIN shadow h ON h.story_id = s.story_id AND h.status = 'ready' AND h.content_hash = md5(s.content) WHERE s.story_id % 41 <> 0 AND h.story_id IS NULL)
SELECT story_id, content_hash, CASE WHEN ok THEN 'ready' ELSE 'failed' END AS status, CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM p""",
    "identity_mismatch": f"WITH {ctes('shadow')}, r AS (SELECT story_id, concat_ws(',', CASE WHEN story_id % 23 = 0 THEN 'model' END, CASE WHEN status <> 'ready' THEN 'status' END) AS reasons FROM shadow) SELECT * FROM r WHERE reasons <> ''",
    "lexical_fallback": f"""WITH {R._PAIRS}, {R.FUSED.replace("rank <= 20 AND similarity >= 0.5", "rank <= 20 AND similarity >= 0.5 AND query_id % 20 <> 0")}
SELECT q.query_id, q.query_id % 20 = 0 AS degraded, story_id, lane, CASE WHEN story_id IS NULL THEN 'empty' WHEN q.query_id % 20 = 0 THEN 'degraded' ELSE 'ok' END AS result_state FROM query_pairs q LEFT JOIN (SELECT * FROM fused WHERE rank = 1) f ON f.query_id = q.query_id""",
    "query_variants": f"WITH {R._PAIRS} SELECT query_id, 'exact' AS variant, text FROM query_pairs UNION ALL SELECT query_id, 'cross_tool', regexp_replace(text, '[A-Za-z0-9_]{{9,}}', 'it', 'g') FROM query_pairs UNION ALL SELECT query_id, 'ambiguous', split_part(text, ' ', 1) FROM query_pairs",
    "transform_join": f"WITH {R._PAIRS}, made AS (SELECT DISTINCT text FROM query_pairs WHERE query_id % 30 <> 0) SELECT query_id, upper(replace(m.text, 'ß', 'SS')) AS output FROM query_pairs q LEFT JOIN made m ON m.text = q.text",
    "source_descriptors": f"""WITH {ctes('stories')} SELECT story_id, concat(CASE WHEN story_id % 2 = 0 OR story_id % 3 = 0 THEN story_id::VARCHAR ELSE '-' END, ':', lang, CASE WHEN story_id % 2 = 0 THEN '' WHEN story_id % 3 = 0 THEN '' ELSE concat(',', story_id, ':-') END, CASE WHEN story_id % 3 = 0 THEN '' ELSE concat(',', story_id + 1, ':-') END) AS sources FROM stories""",
}

QUERIES = {name: globals()[name] for name in SQL}

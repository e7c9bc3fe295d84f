"""Registered queries on what leaves the engine and what comes back, and their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import consolidate, delivery, fusion, graph, lexical
from engram.params import DEFAULTS
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import QUERIES_SQL, ctes

BUDGET = 60


def event_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under labels of every kind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 9
    label = F.when(k == 0, "create").when(k == 1, " Migrate ").when(k == 2, "MERGE").when(k == 3, "split_child").when(k == 4, "Delete").when(k == 5, "").when(k > 6, F.col("event_type"))
    return e.select("event_id", delivery.operation_of(label).alias("operation"))


def project_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.stories(spark, sf_dir)
    i = F.col("story_id")
    workspace = F.struct(F.when(i % 3 == 0, F.concat(F.lit("sha256:"), "source")).when(i % 3 == 1, F.lit("")).when(i % 6 == 2, F.concat(F.lit("local:"), "source")).alias("repo_fingerprint"), F.when(i % 2 == 0, F.col("source")).alias("path_fingerprint"), F.when(i % 5 > 0, F.col("lang")).alias("id"))
    p = delivery.project_identity(workspace)
    return s.select("story_id", p["kind"].alias("kind"), p["value"].alias("value"), p["strong"].alias("strong"), F.array_join(p["ids"], ",").alias("ids"))


def environment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.frame(spark, sf_dir, "environments")
    rule = F.to_json(F.struct(F.col("arch").alias("arch"), F.col("runtime_kind").alias("kind")))
    return e.select("story_id", delivery.environment_label(*map(F.col, ("tool_type", "workspace_id", "runtime_kind", "os_family", "arch"))).alias("label"), rule.alias("applies"))


def recall_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, s = fusion.vector_lane(views.queries(spark, sf_dir), R.stories(spark, sf_dir), 3, 0.5), R.stories(spark, sf_dir)
    active = views.frame(spark, sf_dir, "story_state").filter("not deleted and not archived")
    out = delivery.recall_results(hits, s, views.frame(spark, sf_dir, "edges"), active)
    related = F.array_join(F.transform("related", lambda r: F.concat_ws(":", r["story_id"].cast("string"), r["title"], (r["weight"] * 100).cast("int").cast("string"), r["edge_type"], r["directed"].cast("string"), r["direction"])), "|")
    return out.select("query_id", "rank", "story_id", "title", "truncated", "similarity", "count", related.alias("related"))


def briefing_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget so tight that often not even the first entry fits."""
    hits = fusion.vector_lane(views.queries(spark, sf_dir), R.stories(spark, sf_dir), 5, 0.6)
    return delivery.squeezed_briefing(hits, R.stories(spark, sf_dir), BUDGET, 240)


def access_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.bump_access(views.frame(spark, sf_dir, "story_state"), views.frame(spark, sf_dir, "recall_lists"), ["user_id", "day"])


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.decide(consolidate.candidates(views.queries(spark, sf_dir), R.stories(spark, sf_dir)))


def consolidation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.stories(spark, sf_dir).select("story_id", F.array("lang", "source").alias("keywords"), F.array(F.col("story_id")).alias("session_ids"))
    new = views.queries(spark, sf_dir).select("query_id", F.split("text", " ").alias("keywords"), (F.col("query_id") + 1000000).alias("session_id"))
    out = delivery.updated_stories(_decided(spark, sf_dir), new, s)
    return out.select("story_id", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.transform("session_ids", lambda x: x.cast("string")), ",").alias("session_ids"))


def _detail(s: DataFrame, key: str) -> DataFrame:
    return s.select(F.col("story_id").alias(key), F.substring("abstract", 1, 80).alias("abstract"), F.when(F.col("story_id") % 3 > 0, F.col("title")).otherwise(F.lit("")).alias("problem"), F.when(F.col("story_id") % 2 > 0, F.substring("content", 10, 30)).alias("outcome"), F.array("lang").alias("actions"), F.array("source", "lang").alias("evidence"), F.array("source").alias("sources"), F.array("label").alias("applies"))


def consolidation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New stories take the fields of the next story, so that both sides differ."""
    s = R.stories(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    new = _detail(s, "query_id").withColumn("query_id", F.col("query_id") - 1)
    out = delivery.merged_stories(_decided(spark, sf_dir), new, _detail(s, "story_id"))
    return out.select("query_id", "story_id", "abstract", "problem", "outcome", *(F.array_join(c, ",").alias(c) for c in ("actions", "evidence", "sources", "applies")))


def consolidation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges and updates of a batch, a row per story: every query comes a second time for a story six further on, so
    that several of them meet in one story."""
    s = R.stories(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    fields = _detail(s, "query_id").withColumn("query_id", F.col("query_id") - 1)
    asked = views.queries(spark, sf_dir).select("query_id", F.split("text", " ").alias("keywords"))
    new = fields.join(asked.hint("merge"), "query_id").withColumn("session_id", F.col("query_id") + 1000000)
    again = new.withColumn("query_id", F.col("query_id") + 5)
    decided = _decided(spark, sf_dir).select("query_id", "branch", "target")
    twice = decided.unionByName(decided.select((F.col("query_id") + 5).alias("query_id"), F.when(F.col("branch") == "update", "merge").otherwise(F.col("branch")).alias("branch"), "target"))
    old = _detail(s, "story_id").join(s.select("story_id", F.array("lang", "source").alias("keywords"), F.array("story_id").alias("session_ids")).hint("merge"), "story_id")
    out = consolidate.fold_into_targets(twice, new.unionByName(again), old)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("story_id", *consolidate.TEXTS, *map(joined, (*consolidate.LISTS, "keywords", "session_ids")), "n_merged", "n_updated")


def consolidation_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the merges and updates of a batch: those of a target to the other stories that were near are stronger."""
    found = consolidate.candidates(views.queries(spark, sf_dir), R.stories(spark, sf_dir), dataclasses.replace(DEFAULTS, sim_low=0.2))
    pairs = consolidate.update_pairs(found, consolidate.decide(found))
    near = found.filter("rank <= 5").select("query_id", "story_id")
    ties = near.filter("query_id <> story_id").select(F.least("query_id", "story_id").alias("source_id"), F.greatest("query_id", "story_id").alias("target_id")).distinct()
    edges = ties.select((F.col("source_id") * 1000000 + F.col("target_id")).alias("edge_id"), "source_id", "target_id", F.lit("semantic").alias("edge_type"), F.lit(0.3).alias("weight"), F.lit(False).alias("deleted"))
    return graph.reinforce(edges, pairs).select("edge_id", F.round("weight", 6).alias("weight"))


def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.frame(spark, sf_dir, "sessions")
    known = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("known"))).otherwise(F.expr("cast(array() as array<string>)"))
    return s.select("conv_id", F.array_join(delivery.fallback_keywords(known, F.col("problem_desc")), ",").alias("keywords"))


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories split at their lines; some keep their vector, and some children have none. Lines are split where texts are
    read, so that no text is shuffled to the vectors of the stories."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("story_id"), F.split("text", "\n").alias("parts"))
    kids, edges = consolidate.split_story(texts)
    vectors_ = kids.filter("place <> 3").select(F.col("child_id").alias("node")).unionByName(texts.filter("story_id % 11 = 0").select(F.col("story_id").cast("string").alias("node")))
    return delivery.split_audit(R.stories(spark, sf_dir).select("story_id"), kids, edges.filter("source_id not like '%7'"), vectors_)


def exact_term_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose vector says nothing of the story that their words are from: the vector lane against the hybrid."""
    pairs = views.frame(spark, sf_dir, "query_pairs")
    q, s = pairs.select("query_id", "text", vectors.l2_normalize(F.col("b")).alias("vector")), R.stories(spark, sf_dir)
    v = fusion.vector_lane(q, s, R.K, 0.5)
    hybrid = fusion.reciprocal_fusion(v, lexical.lexical_topk(q, R.texts(spark, sf_dir), R.K), R.K)
    return delivery.lane_comparison({"vector": v, "hybrid": hybrid}, pairs.select("query_id", F.col("query_id").alias("story_id")))


def expanded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of every query, one of which says the same again."""
    q = views.queries(spark, sf_dir)
    words = F.split("text", " ")
    variants = q.select("query_id", "vector", F.posexplode(F.array(F.concat(F.lit("  "), "text"), words[0], F.concat_ws(" ", words[1], words[2]))).alias("i", "variant")).select("query_id", (F.col("i") + 1).alias("query_index"), F.col("variant").alias("text"), "vector")
    return delivery.expanded_recall(q, variants, R.stories(spark, sf_dir), 10, R.K, texts=R.texts(spark, sf_dir)).select("query_id", "story_id", F.round("fusion", 6).alias("fusion"), "rank")


_N = f"WITH {R._PAIRS}, {R.VECTOR_LANE}, decided AS (SELECT query_id, story_id, CASE WHEN similarity >= 0.92 THEN 'update' WHEN similarity >= 0.85 THEN 'merge' ELSE 'create' END AS branch FROM vector_lane WHERE rank = 1)"
_BOTH_WAYS = """seen AS (SELECT source_id AS node, target_id AS neighbor, edge_id, edge_type, weight, CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN 'outbound' ELSE 'undirected' END AS direction FROM edges WHERE NOT deleted
    UNION ALL SELECT target_id, source_id, edge_id, edge_type, weight, CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN 'inbound' ELSE 'undirected' END FROM edges WHERE NOT deleted)"""
_ENTRY = "concat('• [', CAST(round_even(similarity * 100, 0) AS INT), '%] ', title, CASE WHEN {0} = '' THEN '' ELSE concat(chr(10), '  ', replace({0}, chr(10), concat(chr(10), '  '))) END)"
_COST = f"CAST(ceil(length({_ENTRY}) / 4.0) AS BIGINT)"
_ENDED = "CASE WHEN {1} <= 0 THEN '' WHEN length({0}) <= {1} THEN {0} ELSE concat(rtrim(substr({0}, 1, {1} - 1)), '…') END"
_JOINED = lambda f, sep: f"concat_ws({sep}, nullif(a.{f}, ''), nullif(b.{f}, ''))"
_SET = lambda a, b: f"CASE WHEN {a} = {b} THEN {a} ELSE concat({a}, ',', {b}) END"

SQL = {
    "event_operations": "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'merge' WHEN 3 THEN 'split' WHEN 4 THEN 'delete' ELSE 'update' END AS operation FROM events",
    "project_identities": f"""WITH {ctes('stories')}, w AS (SELECT story_id, CASE WHEN story_id % 3 = 0 THEN concat('sha256:', source) WHEN story_id % 6 = 2 THEN concat('local:', source) END AS r, CASE WHEN story_id % 2 = 0 THEN source END AS p, CASE WHEN story_id % 5 > 0 THEN lang END AS i FROM stories)
SELECT story_id, CASE WHEN r IS NOT NULL THEN 'repo' WHEN i IS NOT NULL THEN 'workspace' END AS kind, coalesce(r, i) AS value, CASE WHEN story_id % 3 = 0 THEN r END AS strong, array_to_string(list_sort(list_distinct([x FOR x IN [r, p, i] IF x IS NOT NULL])), ',') AS ids FROM w""",
    "environment_labels": f"""WITH {ctes('environments')} SELECT story_id, concat_ws(' · ', nullif(tool_type, 'unknown'), workspace_id, runtime_kind, os_family, arch) AS label, concat('{{"arch":"', arch, '","kind":"', runtime_kind, '"}}') AS applies FROM environments""",
    "recall_results": f"""WITH {ctes('query_pairs', 'story_state', 'edges')}, {R.VECTOR_LANE}, {_BOTH_WAYS}, active AS (SELECT story_id FROM story_state WHERE NOT deleted AND NOT archived),
one AS (SELECT * FROM seen WHERE neighbor IN (SELECT story_id FROM active) QUALIFY row_number() OVER (PARTITION BY node, neighbor ORDER BY weight DESC, edge_id) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id) AS place FROM one QUALIFY place <= 5),
listed AS (SELECT node, string_agg(concat_ws(':', neighbor, title, CAST(trunc(weight * 100) AS INT), edge_type, (direction <> 'undirected')::VARCHAR, direction), '|' ORDER BY place) AS related FROM best JOIN stories ON story_id = neighbor GROUP BY node)
SELECT query_id, rank, h.story_id, title, abstract <> content AS truncated, similarity, count(*) OVER (PARTITION BY query_id) AS count, coalesce(related, '') AS related
FROM vector_lane h JOIN stories s ON s.story_id = h.story_id LEFT JOIN listed ON node = h.story_id WHERE rank <= 3 AND similarity >= 0.5""",
    "briefing_squeeze": f"""WITH RECURSIVE {R._PAIRS}, {R.VECTOR_LANE}, r AS (SELECT query_id, rank, h.story_id, similarity, title, trim(content) AS content, {_ENDED.format('trim(content)', '240')} AS excerpt FROM vector_lane h JOIN stories s ON s.story_id = h.story_id WHERE rank <= 5 AND similarity >= 0.6),
c AS (SELECT *, {_COST.format('excerpt')} AS tokens FROM r), t AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM c),
room AS (SELECT *, 2 * ({BUDGET} - {_COST.format("''")}) AS n FROM t WHERE rank = 1 AND total > {BUDGET}),
small AS (SELECT query_id, rank, story_id, similarity, title, {_ENDED.format('content', 'n')} AS e FROM room WHERE n > 0
    UNION ALL SELECT query_id, rank, story_id, similarity, title, {_ENDED.format('e', '(length(e) // 2)')} FROM small WHERE {_COST.format('e')} > {BUDGET} AND e <> '')
SELECT query_id, rank, story_id, excerpt, tokens, false AS shrunk FROM t WHERE total <= {BUDGET} UNION ALL SELECT query_id, rank, story_id, e, {_COST.format('e')}, true FROM small WHERE e <> '' AND {_COST.format('e')} <= {BUDGET}""",
    "access_bump": f"""WITH {ctes('story_state', 'recall_lists')}, n AS (SELECT story_id, count(*) AS n FROM recall_lists GROUP BY story_id)
SELECT s.story_id, access_count + CASE WHEN NOT deleted AND NOT archived THEN coalesce(n, 0) ELSE 0 END AS access_count, NOT deleted AND NOT archived AND n IS NOT NULL AS bumped FROM story_state s LEFT JOIN n USING (story_id)""",
    "consolidation_update": f"""{_N}, added AS (SELECT d.story_id, d.query_id, text FROM decided d JOIN queries USING (query_id) WHERE branch = 'update'),
w AS (SELECT story_id, unnest(string_split(text, ' ')) AS w FROM added UNION SELECT story_id, lang FROM stories WHERE story_id IN (SELECT story_id FROM added) UNION SELECT story_id, source FROM stories WHERE story_id IN (SELECT story_id FROM added)),
i AS (SELECT story_id, string_agg(query_id + 1000000, ',' ORDER BY query_id) AS ids FROM added GROUP BY story_id)
SELECT story_id, string_agg(w, ',' ORDER BY w) AS keywords, concat(story_id, ',', any_value(ids)) AS session_ids FROM w JOIN i USING (story_id) GROUP BY story_id""",
    "consolidation_merge": f"""{_N}, f AS (SELECT story_id, substr(abstract, 1, 80) AS abstract, CASE WHEN story_id % 3 > 0 THEN title ELSE '' END AS problem, CASE WHEN story_id % 2 > 0 THEN substr(content, 10, 30) END AS outcome, lang, source, label::VARCHAR AS label FROM stories)
SELECT query_id, d.story_id, {_JOINED('abstract', "'；'")} AS abstract, {_JOINED('problem', 'concat(chr(10), chr(10))')} AS problem, {_JOINED('outcome', 'concat(chr(10), chr(10))')} AS outcome, {_SET('a.lang', 'b.lang')} AS actions,
concat(a.source, ',', a.lang, CASE WHEN b.source = a.source THEN '' ELSE concat(',', b.source) END, CASE WHEN b.lang = a.lang THEN '' ELSE concat(',', b.lang) END) AS evidence, {_SET('a.source', 'b.source')} AS sources, {_SET('a.label', 'b.label')} AS applies
FROM decided d JOIN f a ON a.story_id = d.story_id JOIN f b ON b.story_id = query_id + 1 WHERE branch = 'merge'""",
    "consolidation_fold": f"""{_N}, f AS (SELECT story_id, substr(abstract, 1, 80) AS abstract, CASE WHEN story_id % 3 > 0 THEN title ELSE '' END AS problem, CASE WHEN story_id % 2 > 0 THEN substr(content, 10, 30) END AS outcome, lang, source, label::VARCHAR AS label FROM stories),
taken AS (SELECT query_id, query_id AS origin, branch, story_id AS target FROM decided WHERE branch <> 'create' UNION ALL SELECT query_id + 5, query_id, CASE WHEN branch = 'update' THEN 'merge' ELSE branch END, story_id FROM decided WHERE branch <> 'create'),
parts AS (SELECT story_id, -1 AS place, abstract, problem, outcome, [lang] AS actions, [source, lang] AS evidence, [source] AS sources, [label] AS applies, [lang, source] AS keywords, story_id AS session_id, 'old' AS branch FROM f WHERE story_id IN (SELECT target FROM taken)
  UNION ALL SELECT b.target, b.query_id, CASE WHEN b.branch = 'merge' THEN f.abstract END, CASE WHEN b.branch = 'merge' THEN f.problem END, CASE WHEN b.branch = 'merge' THEN f.outcome END, CASE WHEN b.branch = 'merge' THEN [f.lang] END, CASE WHEN b.branch = 'merge' THEN [f.source, f.lang] END,
    CASE WHEN b.branch = 'merge' THEN [f.source] END, CASE WHEN b.branch = 'merge' THEN [f.label] END, string_split(q.text, ' '), b.origin + 1000000, b.branch
  FROM taken b JOIN f ON f.story_id = b.origin + 1 JOIN queries q ON q.query_id = b.origin),
{", ".join(f"{c}_items AS (SELECT story_id, v, min(place * 10 + i) AS first FROM (SELECT story_id, place, unnest({c}) AS v, generate_subscripts({c}, 1) AS i FROM parts) WHERE v IS NOT NULL GROUP BY story_id, v), {c}_lists AS (SELECT story_id, string_agg(v, ',' ORDER BY {'v' if c == 'keywords' else 'first'}) AS {c} FROM {c}_items GROUP BY story_id)" for c in ("actions", "evidence", "sources", "applies", "keywords"))},
ids AS (SELECT story_id, string_agg(session_id, ',' ORDER BY place) AS session_ids FROM (SELECT story_id, session_id, min(place) AS place FROM parts GROUP BY ALL) GROUP BY story_id),
texts AS (SELECT story_id, {", ".join(f"coalesce(string_agg({c}, {mark} ORDER BY place) FILTER (WHERE {c} <> ''), '') AS {c}" for c, mark in (("abstract", "'；'"), ("problem", "chr(10) || chr(10)"), ("outcome", "chr(10) || chr(10)")))},
  count(*) FILTER (WHERE branch = 'merge') AS n_merged, count(*) FILTER (WHERE branch = 'update') AS n_updated FROM parts GROUP BY story_id)
SELECT t.*, coalesce(actions, '') AS actions, coalesce(evidence, '') AS evidence, coalesce(sources, '') AS sources, coalesce(applies, '') AS applies, keywords, session_ids
FROM texts t LEFT JOIN actions_lists USING (story_id) LEFT JOIN evidence_lists USING (story_id) LEFT JOIN sources_lists USING (story_id) LEFT JOIN applies_lists USING (story_id) JOIN keywords_lists USING (story_id) JOIN ids USING (story_id)""",
    "consolidation_reinforce": f"""{_N}, found AS (SELECT * FROM vector_lane WHERE rank <= 5),
ties AS (SELECT DISTINCT least(query_id, story_id) AS a, greatest(query_id, story_id) AS b FROM found WHERE query_id <> story_id),
pairs AS (SELECT least(d.story_id, o.story_id) AS a, greatest(d.story_id, o.story_id) AS b, count(*) AS n FROM decided d JOIN found o USING (query_id) WHERE branch <> 'create' AND o.similarity >= 0.2 AND o.story_id <> d.story_id GROUP BY ALL)
SELECT a * 1000000 + b AS edge_id, round(CASE WHEN n IS NULL THEN 0.3 ELSE least(1.0, 0.3 + 0.1 * n) END, 6)::DOUBLE AS weight FROM ties LEFT JOIN pairs USING (a, b)""",
    "fallback_keywords": rf"WITH {ctes('sessions')} SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'known' ELSE array_to_string(regexp_extract_all(coalesce(problem_desc, ''), '[^ \t\n\x0B\f\r]+')[1:5], ',') END AS keywords FROM sessions",
    "split_audit": f"""WITH {ctes('stories')}, p AS (SELECT story_id, len(string_split(content, chr(10))) AS n FROM stories)
SELECT story_id, n::BIGINT AS child_count, n >= 2 AS triggered, story_id % 11 <> 0 AS parent_vector_removed, story_id % 10 <> 7 AS edges_ok, n <= 3 AS vectors_ok FROM p""",
    "exact_term_ablation": f"""WITH {R._PAIRS}, {R.FUSED.replace('a[i]::DOUBLE + share * b[i]::DOUBLE', 'b[i]::DOUBLE')}, n AS (SELECT count(*) AS n FROM query_pairs)
SELECT 'vector' AS lane, round((SELECT count(*) FROM vector_lane WHERE rank <= 3 AND similarity >= 0.5 AND story_id = query_id) / n, 4) AS recall, n FROM n UNION ALL SELECT 'hybrid', round((SELECT count(*) FROM fused WHERE rank <= 3 AND story_id = query_id) / n, 4), n FROM n""",
    "expanded_recall": f"""WITH {R._PAIRS}, {R.FUSED}, said AS (SELECT query_id, text, vector, 2 AS i, split_part(text, ' ', 1) AS variant FROM queries UNION ALL SELECT query_id, text, vector, 3, concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) FROM queries),
other AS (SELECT query_id, vector, variant, i, row_number() OVER (PARTITION BY query_id ORDER BY i) AS place FROM said WHERE lower(trim(regexp_replace(variant, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(variant, '\\s+', ' ', 'g'))) ORDER BY i) = 1),
expanded AS (WITH {R.FUSED.replace(QUERIES_SQL, "queries AS (SELECT query_id * 16 + place AS query_id, NULL::VARCHAR AS source, variant AS text, vector FROM other)")} SELECT query_id // 16 AS query_id, query_id % 16 AS ranking, story_id, fusion, rank FROM fused),
most AS (SELECT query_id, count(DISTINCT ranking) / 61.0::DOUBLE AS most FROM expanded GROUP BY query_id),
votes AS (SELECT query_id, story_id, sum(1.0::DOUBLE / (60 + rank)) AS votes, max(fusion) AS t_score, arg_min(fusion, ranking) AS first FROM expanded GROUP BY ALL),
signal AS (SELECT query_id, story_id, 0.6 * votes / most + 0.4 * t_score AS signal, first FROM votes JOIN most USING (query_id)),
merged AS (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.story_id, s.story_id) AS story_id, round(least(1.0, greatest(0.0, 1 - (1 - coalesce(fusion, first)) * (1 - 0.35 * coalesce(signal, 0)))), 8) AS fusion FROM fused f FULL JOIN signal s ON f.query_id = s.query_id AND f.story_id = s.story_id)
SELECT query_id, story_id, round(fusion, 6) AS fusion, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, story_id) AS rank FROM merged QUALIFY rank <= 10""",
}

QUERIES = {name: globals()[name] for name in SQL}

"""Registered story, consolidation and ingestion queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import context as C
from engram.functions import text as T
from engram.operators import consolidate, stories
from engram.params import DEFAULTS
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import ctes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def consolidation_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.decide(consolidate.candidates(views.queries(spark, sf_dir), R.stories(spark, sf_dir)))


def consolidation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consolidate.candidates(views.queries(spark, sf_dir).withColumn("query_id", F.col("query_id") + 1000000), R.stories(spark, sf_dir))
    return consolidate.create_edges(found, consolidate.decide(found))


def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = R.stories(spark, sf_dir).select("story_id", F.split("content", "\n").alias("parts"))
    return consolidate.split_story(parents)[1]


def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.stories(spark, sf_dir).select("label", "story_id", F.array("source", "lang").alias("tags"))
    return consolidate.merge_lists(rows, "label", ["tags"], "story_id").select("label", F.array_join("tags", ",").alias("tags"))


def inference_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    memo = docs.filter("doc_id % 4 = 0").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("input_hash")).distinct()
    return consolidate.inference_memo(docs, memo, "text")


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = views.frame(spark, sf_dir, "sessions")
    turns = _table(spark, sf_dir, "conversations").filter("turn > 0 and conv_id % 5 <> 0").select("conv_id", ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("failed"))
    return consolidate.fold_status(sessions, turns)


def story_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("story_id"), F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.substring("text", 1, 40)).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 700)).alias("abstract"),
        F.when(F.col("doc_id") % 5 > 0, F.substring("text", 1, 50)).alias("problem"), F.when(F.col("doc_id") % 5 > 1, F.substring("text", 20, 400)).alias("outcome"), F.col("text").alias("content"), F.array("lang", "source", "lang", F.lit(" ")).alias("keywords"),
    )
    return stories.normalize(d).withColumn("keywords", F.array_join("keywords", ","))


def story_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 300)).alias("abstract"), F.col("text").alias("content"))
    return stories.recall_summary(d).select("doc_id", "summary", "truncated")


def render_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    detail = F.struct(F.when(F.col("doc_id") % 4 > 0, F.element_at(lines, 1)).alias("problem"), F.slice(lines, 1, 3).alias("actions"), F.element_at(lines, -1).alias("outcome"), F.array("lang", "source").alias("pitfalls"))
    return d.select("doc_id", detail.alias("detail")).select("doc_id", stories.render_detail(F.col("detail")).alias("body"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.stories(spark, sf_dir).withColumn("keywords", F.array("lang", "source"))
    return stories.embedding_texts(d).select("story_id", "representation", F.length("text").alias("chars"), stories.content_hash(F.col("representation"), F.col("text")).alias("content_hash"))


def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of one project, asked for with a remote identity and with a workspace only."""
    env = views.frame(spark, sf_dir, "environments").select("story_id", F.array(F.struct(
        F.when(F.col("story_id") % 3 == 0, F.concat(F.lit("sha256:"), F.col("workspace_id"))).alias("remote_id"), F.col("workspace_id").alias("repo_fingerprint"), F.col("arch").alias("path_fingerprint"), F.col("tool_type").alias("workspace_id"))).alias("env"))
    ours = stories.in_project(F.col("env"), F.lit("sha256:src1"), F.array(F.lit("src1"), F.lit("cli")))
    return env.select("story_id", ours.alias("ours"))


def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda kind, field, *vals: F.struct(F.lit(kind).alias("kind"), F.array(F.struct(F.lit(field).alias("field"), F.array(*map(F.lit, vals)).alias("vals"))).alias("conds"))
    env = views.frame(spark, sf_dir, "environments").withColumn("current", F.create_map(F.lit("runtime"), "runtime_kind", F.lit("arch"), "arch"))
    rules = F.when(F.col("story_id") % 2 == 0, F.array(rule("applies", "runtime", "local", "ci"), rule("excludes", "arch", "arm64"))).otherwise(F.array(rule("excludes", "runtime", "remote")))
    return stories.applicable(env.withColumn("rules", rules)).select("story_id", F.round("applicability_score", 6).alias("applicability_score"), "excluded")


def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.redact(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(out, "UTF-8")).alias("digest"), F.size(F.split(out, r"\[REDACTED\]")).alias("pieces"))


def repo_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses in three ways to write a repository."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/+$", "").alias("rest"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("HTTPS://user:pw@"), "rest", F.lit(".git"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ssh://git@"), "rest", F.lit("/"))).otherwise(F.concat(F.lit("git@"), F.regexp_replace("rest", "^([^/]+)/", "$1:")))
    return p.select("page_id", C.repository_fingerprint(url).alias("fingerprint"))


def transcript_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as bounded transcripts with first question and last answer."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    cap = DEFAULTS.transcript_chars
    whole = stories.reaching(turns, "conv_id", "turn", "line", cap).groupBy("conv_id").agg(stories.transcript("turn", "line", cap).alias("transcript"))
    return whole.join(views.frame(spark, sf_dir, "sessions").hint("merge"), "conv_id").select("conv_id", "transcript", "problem_desc", "conclusion")


def cwd_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+:/", "")
    return _table(spark, sf_dir, "pages").select("page_id", C.cwd_to_query(F.when(F.col("page_id") % 2 == 0, F.concat(path, F.element_at(F.array(*map(F.lit, ("/src/.cache", "/app/usr", "/packages/node_modules", "/main/LIB", "/user/etc"))), (F.col("page_id") % 5 + 1).cast("int")))).otherwise(path)).alias("query"))


#: Directory names that say nothing about a project, for the other engine.
_GENERIC = """
    'src', 'code', 'app', 'apps', 'application', 'applications', 'project', 'projects', 'workspace', 'workspaces', 'work', 'home', 'users', 'usr', 'var', 'tmp', 'temp', 'dev', 'etc',
    'bin', 'lib', 'libs', 'dist', 'build', 'out', 'node_modules', 'packages', 'main', 'master', 'trunk'
"""
_N = f"WITH {R._PAIRS}, {R.VECTOR_LANE}"
_FOUND = "found AS (SELECT *, CASE WHEN similarity >= 0.85 THEN 'high' WHEN similarity >= 0.75 THEN 'low' ELSE 'none' END AS band FROM vector_lane WHERE rank <= 5), decided AS (SELECT query_id, similarity, story_id, CASE WHEN similarity >= 0.92 THEN 'update' WHEN similarity >= 0.85 THEN 'merge' ELSE 'create' END AS branch FROM vector_lane WHERE rank = 1)"
_REDACT = "text"
for _p in T.SECRETS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"

SQL = {
    "consolidation_branch": f"{_N}, {_FOUND} SELECT query_id, branch, CASE WHEN branch <> 'create' THEN story_id END AS target, similarity FROM decided",
    "consolidation_edges": f"{_N}, {_FOUND} SELECT story_id AS source_id, query_id + 1000000 AS target_id, 'semantic' AS edge_type, similarity AS weight FROM found WHERE band = 'low' AND query_id IN (SELECT query_id FROM decided WHERE branch = 'create')",
    "split_edges": f"""WITH {ctes('stories')}, parts AS (SELECT story_id, len(string_split(content, chr(10))) AS n FROM stories), kids AS (SELECT story_id, unnest(range(0, n)) AS place FROM parts)
SELECT story_id::VARCHAR AS source_id, concat(story_id, '-', place) AS target_id, 'parent_child' AS edge_type, 1.0::DOUBLE AS weight FROM kids UNION ALL SELECT concat(a.story_id, '-', a.place), concat(b.story_id, '-', b.place), 'semantic', 0.5 FROM kids a JOIN kids b ON a.story_id = b.story_id AND a.place < b.place""",
    "merge_lists": f"""WITH {ctes('stories')}, t AS (SELECT label, source AS tag, story_id * 2 AS place FROM stories UNION ALL SELECT label, lang, story_id * 2 + 1 FROM stories), f AS (SELECT label, tag, min(place) AS place FROM t GROUP BY label, tag) SELECT label, string_agg(tag, ',' ORDER BY place) AS tags FROM f GROUP BY label""",
    "inference_memo": "WITH h AS (SELECT sha256(text) AS input_hash, doc_id FROM documents) SELECT input_hash, count(*) AS uses, bool_or(doc_id % 4 = 0) AS cached FROM h GROUP BY input_hash",
    "session_fold": f"WITH {ctes('sessions')}, r AS (SELECT conv_id, max(((conv_id + turn) % 7 = 0)::INT) AS failed FROM conversations WHERE turn > 0 AND conv_id % 5 <> 0 GROUP BY conv_id) SELECT s.conv_id, CASE failed WHEN 1 THEN 'failed' WHEN 0 THEN 'processed' ELSE 'pending' END AS status FROM sessions s LEFT JOIN r USING (conv_id)",
    "story_normalize": """WITH d AS (SELECT doc_id AS story_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE substr(text, 1, 40) END AS title, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 700) END AS abstract, CASE WHEN doc_id % 5 > 0 THEN substr(text, 1, 50) END AS problem, CASE WHEN doc_id % 5 > 1 THEN substr(text, 20, 400) END AS outcome, text AS content, lang, source FROM documents)
SELECT story_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, rtrim(substr(coalesce(nullif(trim(abstract), ''), nullif(concat_ws('；', nullif(trim(problem), ''), nullif(trim(outcome), '')), ''), nullif(trim(content), ''), ''), 1, 600)) AS abstract, content, concat(lang, ',', source) AS keywords FROM d""",
    "story_summary": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND trim(text) <> '' THEN substr(text, 1, 300) ELSE rtrim(substr(text, 1, 600)) END AS summary, CASE WHEN doc_id % 3 > 0 AND trim(text) <> '' THEN substr(text, 1, 300) <> text ELSE length(text) > 600 END AS truncated FROM documents""",
    "render_detail": """WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 4 > 0 AND l[1] <> '' THEN 'problem: ' || l[1] END, array_to_string(list_transform(list_zip(l[1:3], range(1, 4)), lambda x: CASE WHEN x[1] IS NULL THEN NULL ELSE x[2] || '. ' || x[1] END), chr(10)), CASE WHEN l[-1] <> '' THEN 'outcome: ' || l[-1] END, 'pitfalls: ' || lang || '; ' || source) AS body FROM l""",
    "content_hash": f"""WITH {ctes('stories')}, t AS (SELECT story_id, trim(title) AS a, trim(abstract) AS b, trim(content) AS c, concat(lang, ' ', source) AS k FROM stories),
r AS (SELECT story_id, 'legacy' AS representation, concat_ws(chr(10), k, nullif(c, '')) AS text FROM t UNION ALL SELECT story_id, 'full', concat_ws(chr(10), nullif(a, ''), nullif(b, ''), nullif(c, '')) FROM t UNION ALL SELECT story_id, 'default', concat_ws(chr(10), nullif(a, ''), nullif(b, '')) FROM t
  UNION ALL SELECT story_id, 'multi_vector:title', a FROM t UNION ALL SELECT story_id, 'multi_vector:abstract', b FROM t UNION ALL SELECT story_id, 'multi_vector:content', c FROM t)
SELECT story_id, representation, length(text) AS chars, sha256(concat(representation, chr(10), text)) AS content_hash FROM r WHERE text <> ''""",
    "project_scope": f"WITH {ctes('environments')} SELECT story_id, CASE WHEN story_id % 3 = 0 THEN workspace_id = 'src1' ELSE workspace_id = 'src1' OR tool_type = 'cli' END AS ours FROM environments",
    "applicability": f"""WITH {ctes('environments')}, t AS (SELECT story_id, story_id % 2 = 0 AS even, runtime_kind IN ('local', 'ci') AS met, CASE WHEN story_id % 2 = 0 THEN arch = 'arm64' ELSE runtime_kind = 'remote' END AS barred FROM environments)
SELECT story_id, round((CASE WHEN NOT even THEN 0 WHEN met THEN 0.12 ELSE -0.20 END + CASE WHEN barred THEN -0.35 ELSE 0 END)::DOUBLE, 6) AS applicability_score, (even AND NOT met) OR barred AS excluded FROM t""",
    "secret_redaction": f"WITH r AS (SELECT doc_id, {_REDACT} AS out FROM documents) SELECT doc_id, md5(out) AS digest, len(string_split(out, '[REDACTED]')) AS pieces FROM r",
    "repo_fingerprint": "SELECT page_id, concat('sha256:', sha256(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')), '/+$', ''), '\\.git$', ''))) AS fingerprint FROM pages",
    "transcript_assembly": f"""WITH {ctes('sessions')}, w AS (SELECT conv_id, string_agg(concat('[', role, '] ', text), chr(10) ORDER BY turn, text) AS whole FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(whole) > 6000 THEN concat(substr(whole, 1, 3000), chr(10), '...', chr(10), right(whole, 3000)) ELSE whole END AS transcript, problem_desc, conclusion FROM w JOIN sessions USING (conv_id)""",
    "cwd_queries": f"""WITH p AS (SELECT page_id, list_filter(string_split(CASE WHEN page_id % 2 = 0 THEN concat(regexp_replace(url, '^[a-z]+:/', ''), ['/src/.cache', '/app/usr', '/packages/node_modules', '/main/LIB', '/user/etc'][page_id % 5 + 1]) ELSE regexp_replace(url, '^[a-z]+:/', '') END, '/'), lambda x: x <> '') AS parts FROM pages),
n AS (SELECT page_id, parts, list_filter(parts, lambda x: NOT starts_with(x, '.') AND lower(x) NOT IN ({_GENERIC})) AS named FROM p) SELECT page_id, translate(coalesce(named[-1], parts[-1]), '-_', '  ') AS query FROM n""",
}

QUERIES = {name: globals()[name] for name in SQL}

"""Derived views on the given tables, as SQL that both engines read unchanged (vectors aside).

A view is a common table expression; `ctes` puts the needed ones before a query, and `frame` runs one in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import vectors

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "stories": """SELECT d.doc_id AS story_id, substr(d.text, 1, 60) AS title, substr(d.text, 1, 600) AS abstract, d.text AS content,
        d.lang AS lang, d.source AS source, e.embedding AS embedding, e.label AS label
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    "story_count": "SELECT count(*) AS n FROM stories",
    "story_state": """SELECT story_id, label, source, lang, story_id % 7 AS access_count, DATE '2024-01-01' + CAST(story_id % 200 AS INT) AS last_day,
        CASE WHEN story_id % 10 IN (1, 2) THEN story_id - story_id % 10 END AS parent_id,
        story_id % 41 = 0 AS deleted, story_id % 37 = 0 AS archived, embedding IS NULL OR story_id % 53 = 0 AS no_vector FROM stories""",
    "query_pairs": """SELECT q.story_id AS query_id, q.source AS source, q.lang AS lang, q.embedding AS a, n.embedding AS b,
        CASE CAST(floor(q.story_id / 10) AS BIGINT) % 4 WHEN 0 THEN CAST(0.25 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS share,
        concat(split_part(q.content, ' ', 2), ' ', split_part(q.content, ' ', 3), ' ', split_part(q.content, ' ', 4)) AS text
        FROM stories q JOIN stories n ON n.story_id = q.story_id + 1 WHERE q.story_id % 10 = 0 AND q.embedding IS NOT NULL AND n.embedding IS NOT NULL""",
    "edges_raw": """SELECT prior % n AS source_id, event_id % n AS target_id, CASE WHEN prior_type = 'error' THEN 'causal' ELSE 'temporal' END AS edge_type,
          CAST(30 + event_id % 70 AS DOUBLE) / 100 AS weight, 1 + CASE WHEN prior_type = 'error' THEN 1 ELSE 0 END AS type_no
        FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior,
                     lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_type FROM events) CROSS JOIN story_count WHERE prior IS NOT NULL
        UNION ALL SELECT story_id, keeper, 'supersedes', CAST(1.0 AS DOUBLE), 3 FROM (SELECT story_id, min(story_id) OVER (PARTITION BY content) AS keeper FROM stories) WHERE keeper < story_id
        UNION ALL SELECT prior, story_id, 'same_environment', CAST(50 + story_id % 50 AS DOUBLE) / 100, 4 FROM (SELECT story_id, lag(story_id) OVER (PARTITION BY source, lang ORDER BY story_id) AS prior FROM stories) WHERE prior IS NOT NULL
        UNION ALL SELECT parent_id, story_id, 'parent_child', CAST(1.0 AS DOUBLE), 5 FROM story_state WHERE parent_id IS NOT NULL
        UNION ALL SELECT prior, story_id, 'semantic', CAST(75 + story_id % 25 AS DOUBLE) / 100, 6 FROM (SELECT story_id, lag(story_id) OVER (PARTITION BY label ORDER BY story_id) AS prior FROM stories WHERE label IS NOT NULL) WHERE prior IS NOT NULL""",
    "edges": """SELECT (type_no * n + source_id) * n + target_id AS edge_id, source_id, target_id, edge_type, max(weight) AS weight, (source_id + target_id) % 23 = 0 AS deleted,
        DATE '2024-01-01' + CAST((source_id + target_id) % 60 AS INT) AS updated_day
        FROM edges_raw CROSS JOIN story_count WHERE source_id <> target_id GROUP BY type_no, n, source_id, target_id, edge_type""",
    "edges_aged": """SELECT edge_id, source_id, target_id, edge_type, round(weight * pow(CAST(0.5 AS DOUBLE), CAST(152 - (source_id + target_id) % 60 AS DOUBLE) / 50), 6) AS weight, deleted FROM edges""",
    "environments": """SELECT story_id, source AS workspace_id, CASE story_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'container' WHEN 2 THEN 'ci' ELSE 'remote' END AS runtime_kind,
        CASE WHEN story_id % 11 = 0 THEN NULL WHEN story_id % 3 = 0 THEN 'linux' WHEN story_id % 3 = 1 THEN 'macos' ELSE 'windows' END AS os_family,
        CASE story_id % 2 WHEN 0 THEN 'x86_64' ELSE 'arm64' END AS arch,
        CASE story_id % 5 WHEN 0 THEN 'cli' WHEN 1 THEN 'ide' WHEN 2 THEN 'other' WHEN 3 THEN 'web' ELSE 'unknown' END AS tool_type FROM stories""",
    "recall_lists": """SELECT user_id, day, story_id FROM (SELECT user_id, day, story_id, row_number() OVER (PARTITION BY user_id, day ORDER BY first_ts, story_id) AS place
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id % n AS story_id, min(ts) AS first_ts FROM events CROSS JOIN story_count GROUP BY user_id, CAST(ts AS DATE), event_id % n)) WHERE place <= 3""",
    "memory_events": """SELECT event_id AS sequence, user_id AS entity_id, operation, k, ts AS created_at,
          CASE WHEN stale THEN c + 1 ELSE c - 1 END AS base_version, CASE WHEN stale THEN c + 2 ELSE c END AS version
        FROM (SELECT *, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c
          FROM (SELECT *, k % 10 = 5 AND operation <> 'delete' AS stale FROM (SELECT event_id, user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
             CASE WHEN event_type = 'error' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) = 0 THEN 'delete' WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'view' THEN 'update'
                  WHEN event_type = 'purchase' THEN 'merge' ELSE 'split' END AS operation FROM events)))""",
    "diagnostics": """SELECT event_id AS request_id, ts, CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'fast' WHEN 'error' THEN 'deep' ELSE 'auto' END AS mode, k < 5 AS degraded, k % 3 = 0 AS cache_hit,
        k % 7 = 0 AS fallback, value AS total_ms, value * 0.5 AS embed_ms, value * 0.25 AS vector_ms FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "sessions_incoming": """SELECT CASE WHEN conv_id % 11 = 0 THEN conv_id + 1000000 ELSE conv_id END AS conv_id, problem_desc, CASE WHEN conv_id % 5 = 0 THEN conclusion || ' (edited)' ELSE conclusion END AS conclusion
        FROM sessions WHERE conv_id % 7 <> 0""",
    "sessions": """SELECT conv_id, max(CASE WHEN place = first_user THEN substr(text, 1, 200) END) AS problem_desc, max(CASE WHEN place = last_assistant THEN substr(text, 1, 300) END) AS conclusion, count(*) AS n_turns
        FROM (SELECT conv_id, turn AS place, role, text, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first_user,
              max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_assistant FROM conversations) GROUP BY conv_id""",
    "shadow": """SELECT story_id, CASE WHEN story_id % 13 = 0 THEN 'stale' ELSE md5(content) END AS content_hash, CASE WHEN story_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status, 'm1' AS model, 64 AS dimension
        FROM stories WHERE story_id % 19 <> 0""",
    "vector_ids": "SELECT story_id FROM stories WHERE story_id % 29 <> 0 UNION ALL SELECT story_id + 1000000 FROM stories WHERE story_id % 31 = 0",
    "files_old": "SELECT url, length(html) AS size, page_id % 100 AS mtime, md5(html) AS digest, 1 AS adapter FROM pages WHERE page_id % 10 <> 3",
    "files_new": """SELECT url, CASE WHEN page_id % 10 = 4 THEN length(html) + 10 WHEN page_id % 10 = 5 THEN length(html) - 10 ELSE length(html) END AS size,
        CASE WHEN page_id % 10 IN (4, 5, 6) THEN page_id % 100 + 1 ELSE page_id % 100 END AS mtime, CASE WHEN page_id % 10 = 6 THEN md5(concat(html, 'x')) ELSE md5(html) END AS digest, CASE WHEN page_id % 10 = 7 THEN 2 ELSE 1 END AS adapter
        FROM pages WHERE page_id % 10 <> 8""",
}


def needed(names: list[str]) -> list[str]:
    """The views that these stand on, and these, each after what it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and other not in out and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def ctes(*names: str) -> str:
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed(list(names)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = f"WITH {ctes(name)} SELECT * FROM {name}"
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, source, lang, text and the mixed vector of the query."""
    pairs = frame(spark, sf_dir, "query_pairs")
    return pairs.select("query_id", "source", "lang", "text", vectors.mixed(F.col("a"), F.col("b"), F.col("share")).alias("vector"))


#: The same for the other engine: vector arithmetic is the one thing that the two don't write alike.
QUERIES_SQL = """mixed_pairs AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE + share * b[i]::DOUBLE) AS m FROM query_pairs),
queries AS (SELECT query_id, source, lang, text, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS vector FROM mixed_pairs)"""

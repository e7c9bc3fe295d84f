"""The registered comparison of representations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import lifecycle, representations
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.plans.views import ctes
from engram.sources.stage_tables import materialize

#: Variants of a query in one id.
_SLOTS = 4


def representation_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to embed every story, by queries as asked, masked, and cut to a word."""
    asked = lifecycle.expand_queries(views.queries(spark, sf_dir))
    place = F.when(F.col("variant") == "exact", 0).when(F.col("variant") == "cross_tool", 1).otherwise(2)
    asked = asked.select((F.col("query_id") * _SLOTS + place).alias("query_id"), "variant", "text")
    queries = materialize(representations.with_hashed_vectors(asked, F.col("text")), "asked")
    qrels = queries.select("query_id", F.floor(F.col("query_id") / _SLOTS).alias("story_id"))
    embedded = representations.counted_texts(R.texts(spark, sf_dir).withColumn("keywords", F.array("lang", "source")))
    return representations.representation_ablation(queries, qrels, embedded, 0.3)


SQL = {
    "representation_ablation": rf"""WITH {ctes('stories', 'query_pairs')},
t AS (SELECT story_id, trim(title) AS a, trim(abstract) AS b, trim(content) AS c, concat(lang, ' ', source) AS k FROM stories),
texts AS (SELECT story_id, 'legacy' AS mode, '' AS field, concat_ws(chr(10), k, nullif(c, '')) AS text FROM t UNION ALL SELECT story_id, 'full', '', concat_ws(chr(10), nullif(a, ''), nullif(b, ''), nullif(c, '')) FROM t
  UNION ALL SELECT story_id, 'default', '', concat_ws(chr(10), nullif(a, ''), nullif(b, '')) FROM t UNION ALL SELECT story_id, 'multi_vector', 'title', a FROM t UNION ALL SELECT story_id, 'multi_vector', 'abstract', b FROM t
  UNION ALL SELECT story_id, 'multi_vector', 'content', c FROM t),
asked AS (SELECT query_id * 4 AS query_id, 'exact' AS variant, text FROM query_pairs UNION ALL SELECT query_id * 4 + 1, 'cross_tool', regexp_replace(text, '[A-Za-z0-9_]{{9,}}', 'it', 'g') FROM query_pairs
  UNION ALL SELECT query_id * 4 + 2, 'ambiguous', split_part(text, ' ', 1) FROM query_pairs),
terms AS (SELECT story_id AS id, mode, field, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+')) AS term FROM texts
  UNION ALL SELECT query_id, 'query', '', unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+')) FROM asked),
hashed AS (SELECT id, mode, field, cast('0x' || substring(md5(term), 1, 8) AS BIGINT) % 64 AS place, CASE WHEN cast('0x' || substring(md5(term), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM terms),
counts AS (SELECT id, mode, field, place, sum(sign)::DOUBLE AS n FROM hashed GROUP BY ALL HAVING sum(sign) <> 0),
norms AS (SELECT id, mode, field, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL),
units AS (SELECT id, mode, field, place, n / norm AS x FROM counts JOIN norms USING (id, mode, field)),
by_field AS (SELECT q.id AS query_id, s.id AS story_id, s.mode, s.field, sum(q.x * s.x) AS dot FROM units q JOIN units s ON s.place = q.place AND q.mode = 'query' AND s.mode <> 'query' GROUP BY ALL),
pairs AS (SELECT query_id, story_id, mode, max(dot) AS best FROM (SELECT a.query_id, n.id AS story_id, n.mode, n.field, coalesce(f.dot, 0) AS dot
  FROM (SELECT id AS query_id FROM norms WHERE mode = 'query') a CROSS JOIN (SELECT * FROM norms WHERE mode <> 'query') n LEFT JOIN by_field f ON f.query_id = a.query_id AND f.story_id = n.id AND f.mode = n.mode AND f.field = n.field) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY round(best, 6) DESC, story_id) AS rank FROM pairs),
first AS (SELECT a.query_id, a.variant, m.mode, r.best, CASE WHEN r.rank <= 50 AND round(r.best, 6) >= 0.3 THEN r.rank END AS rank
  FROM asked a JOIN (SELECT id FROM norms WHERE mode = 'query') n ON n.id = a.query_id CROSS JOIN (SELECT DISTINCT mode FROM texts) m LEFT JOIN ranked r ON r.query_id = a.query_id AND r.mode = m.mode AND r.story_id = a.query_id // 4),
means AS (SELECT mode, variant, count(*) AS n, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_3, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, round(coalesce(avg(best), 0), 4) AS right_similarity FROM first GROUP BY mode, ROLLUP (variant)),
stored AS (SELECT mode, count(DISTINCT id) AS n_stories FROM norms WHERE mode <> 'query' GROUP BY mode),
gate AS (SELECT round(max(CASE WHEN mode = 'default' THEN recall_3 END) - max(CASE WHEN mode = 'legacy' THEN recall_3 END), 4) >= -0.02 AS keeps FROM means WHERE variant IS NULL)
SELECT mode, variant, n, recall_3, mrr, right_similarity, n_stories, CASE WHEN mode = 'multi_vector' THEN 3 ELSE 1 END AS vectors_per_story, mode = CASE WHEN keeps THEN 'default' ELSE 'legacy' END AS selected FROM means JOIN stored USING (mode), gate""",
}
QUERIES = {name: globals()[name] for name in SQL}

"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import fusion, lexical, vector
from engram.plans import views
from engram.plans.views import QUERIES_SQL, ctes
from engram.sources.stage_tables import materialize

K = 20


def _dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Texts that lie in fewer splits than there are cores are dealt out once, since each lane does much work per text; a
    table of many splits is read where it lies."""
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() < cores else rows


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with keywords."""
    return _dealt(spark, sf_dir, views.frame(spark, sf_dir, "stories").withColumn("keywords", F.to_json(F.array("lang", "source"))))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with keywords, without what their vectors' table adds: texts aren't shuffled to it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = d.select(F.col("doc_id").alias("story_id"), F.substring("text", 1, 60).alias("title"), F.substring("text", 1, 600).alias("abstract"), F.col("text").alias("content"), "lang", "source")
    return _dealt(spark, sf_dir, s.withColumn("keywords", F.to_json(F.array("lang", "source"))))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.vector_lane(views.queries(spark, sf_dir), stories(spark, sf_dir), 3, 0.5)


def cosine_project_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.vector_topk(views.queries(spark, sf_dir), stories(spark, sf_dir), 5, unit=False, scope="source")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_topk(views.queries(spark, sf_dir), texts(spark, sf_dir), K)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(views.queries(spark, sf_dir), texts(spark, sf_dir), 10).select("query_id", "rank", "bm25")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = views.queries(spark, sf_dir), stories(spark, sf_dir)
    return fusion.reciprocal_fusion(fusion.vector_lane(q, s, K, 0.5), lexical.lexical_topk(q, texts(spark, sf_dir), K), K)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).withColumn("fusion", F.round("fusion", 6))


def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.gate(views.queries(spark, sf_dir), hybrid(spark, sf_dir))
    return out.select("query_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("transforms", ",").alias("transforms"))


def transform_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expanded rankings per query: the vector lane, and the lexical lane, merged into the hybrid base."""
    q, s = views.queries(spark, sf_dir), stories(spark, sf_dir)
    return merged_lanes(materialize(fusion.vector_lane(q, s, K, 0.5), "vector-lane"), materialize(lexical.lexical_topk(q, texts(spark, sf_dir), K), "lexical-lane"))


def merged_lanes(v: DataFrame, x: DataFrame) -> DataFrame:
    base = fusion.reciprocal_fusion(v, x, 10)
    both = v.select("query_id", "story_id", F.struct(F.lit(1).alias("ranking"), F.col("similarity").alias("fusion"), "rank").alias("v")).join(
        x.select("query_id", "story_id", F.struct(F.lit(2).alias("ranking"), F.col("similarity").alias("fusion"), "rank").alias("x")).hint("merge"), ["query_id", "story_id"], "full_outer"
    )
    lanes = both.select("query_id", "story_id", F.explode(F.array_compact(F.array("v", "x"))).alias("lane")).select("query_id", "story_id", "lane.*")
    return fusion.merge_transformed(base, lanes, 10).select("query_id", "story_id", F.round("fusion", 6).alias("fusion"), "rank")


def environment_rerank(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    env = views.frame(spark, sf_dir, "environments")
    now = env.select(F.col("story_id").alias("query_id"), F.struct("workspace_id", "runtime_kind", "os_family", "arch", "tool_type").alias("now"))
    out = fusion.environment_rerank(hybrid(spark, sf_dir), env, now, 10, strict)
    return out.withColumn("score", F.round("score", 6))


def strict_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment_rerank(spark, sf_dir, strict=True)


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.overlap_rerank(views.queries(spark, sf_dir), hybrid(spark, sf_dir), stories(spark, sf_dir), 8)
    return out.withColumn("score", F.round("score", 5))


def briefing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = views.queries(spark, sf_dir), stories(spark, sf_dir)
    return fusion.briefing(fusion.vector_lane(q, s, 5, 0.6), s)


def lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return d.select("doc_id", F.array_join(T.lexical_terms(text), " ").alias("terms"), F.array_join(F.array_sort(T.rerank_terms(text)), " ").alias("rerank_terms"), T.estimate_tokens(F.col("text")).alias("tokens"))


VECTOR_LANE = f"""{QUERIES_SQL},
vector_all AS (SELECT query_id, story_id, list_sum(list_transform(range(1, len(vector) + 1), lambda i: vector[i] * embedding[i]::DOUBLE)) AS dot, q.source = s.source AS same,
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM queries q, stories s WHERE embedding IS NOT NULL),
vector_lane AS (SELECT query_id, story_id, round(greatest(0, dot), 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, story_id) AS rank FROM vector_all)"""

TERMS = r"""query_tokens AS (SELECT query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+')) AS term, generate_subscripts(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+'), 1) AS place FROM queries),
query_terms AS (SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS n FROM query_tokens GROUP BY query_id, term) WHERE n <= 8),
term_counts AS (SELECT query_id, count(*) AS n_terms FROM query_terms GROUP BY query_id),
folded AS (SELECT story_id, replace(lower(title), 'ß', 'ss') AS title, replace(lower(abstract), 'ß', 'ss') AS abstract, replace(lower(content), 'ß', 'ss') AS content,
    concat('["', lower(lang), '","', lower(source), '"]') AS keywords FROM stories)"""

LEXICAL_LANE = rf"""{TERMS},
by_term AS (SELECT query_id, story_id, sum(3 * contains(title, term)::INT + 2 * contains(abstract, term)::INT + contains(content, term)::INT + 2 * contains(keywords, term)::INT) AS s
    FROM query_terms, folded WHERE contains(title, term) OR contains(abstract, term) OR contains(content, term) OR contains(keywords, term) GROUP BY query_id, story_id),
lexical_scored AS (SELECT b.query_id, b.story_id, n_terms, (b.s + CASE WHEN e = '' THEN 0 ELSE 6 * contains(f.title, e)::INT + 4 * contains(f.abstract, e)::INT + 3 * contains(f.content, e)::INT + 4 * contains(f.keywords, e)::INT END)::DOUBLE AS score
    FROM by_term b JOIN folded f USING (story_id) JOIN (SELECT query_id, trim(replace(lower(text), 'ß', 'ss')) AS e FROM queries) USING (query_id) JOIN term_counts USING (query_id)),
lexical_lane AS (SELECT query_id, story_id, round(least(1.0, score / (17 + 8 * n_terms)), 4) AS similarity, round(score, 4) AS lexical_score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, story_id) AS rank FROM lexical_scored QUALIFY rank <= {K})"""

FUSED = f"""{VECTOR_LANE}, {LEXICAL_LANE},
v AS (SELECT query_id, story_id, similarity AS v_sim, rank() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS v_rank FROM vector_lane WHERE rank <= {K} AND similarity >= 0.5),
x AS (SELECT query_id, story_id, similarity AS l_sim, rank() OVER (PARTITION BY query_id ORDER BY lexical_score DESC) AS l_rank FROM lexical_lane),
met AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.story_id, x.story_id) AS story_id, v_sim, v_rank, l_sim, l_rank FROM v FULL JOIN x ON v.query_id = x.query_id AND v.story_id = x.story_id),
summed AS (SELECT *, least(1.0, (coalesce(1.0 / (60 + v_rank), 0) + coalesce(0.8 / (60 + l_rank), 0)) / (max((v_rank IS NOT NULL)::INT) OVER (PARTITION BY query_id) * 1.0::DOUBLE / 61 + max((l_rank IS NOT NULL)::INT) OVER (PARTITION BY query_id) * 0.8::DOUBLE / 61)) AS rrf FROM met),
scored AS (SELECT query_id, story_id, v_sim AS vector_similarity, l_sim AS lexical_similarity, round(rrf, 6) AS rrf, round(least(1.0, 0.68 * greatest(coalesce(v_sim, 0), 0.9 * coalesce(l_sim, 0)) + 0.32 * rrf), 8) AS fusion,
    round(CASE WHEN coalesce(v_sim, 0) > 0 THEN v_sim ELSE coalesce(l_sim, 0) END, 4) AS similarity, CASE WHEN v_rank IS NOT NULL AND l_rank IS NOT NULL THEN 'hybrid' WHEN v_rank IS NOT NULL THEN 'vector' ELSE 'lexical' END AS lane FROM summed),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, similarity DESC, story_id) AS rank FROM scored QUALIFY rank <= {K})"""

_PAIRS = ctes("query_pairs")
_ENV = f"""WITH {ctes("query_pairs", "environments")}, {FUSED},
compared AS (SELECT f.query_id, f.story_id, f.similarity, f.fusion, f.rank,
    CASE WHEN a.workspace_id = b.workspace_id THEN 0.35 ELSE -0.08 END + CASE WHEN a.runtime_kind = b.runtime_kind THEN 0.25 ELSE -0.25 END
    + CASE WHEN a.os_family IS NULL OR b.os_family IS NULL THEN 0 WHEN a.os_family = b.os_family THEN 0.15 ELSE -0.18 END + CASE WHEN a.arch = b.arch THEN 0.10 ELSE -0.15 END
    + CASE WHEN a.tool_type IN ('other', 'unknown') OR b.tool_type IN ('other', 'unknown') THEN 0 WHEN a.tool_type = b.tool_type THEN 0.08 ELSE -0.03 END AS env,
    a.workspace_id <> b.workspace_id OR a.runtime_kind <> b.runtime_kind OR coalesce(a.os_family <> b.os_family, false) OR a.arch <> b.arch OR (a.tool_type NOT IN ('other', 'unknown') AND b.tool_type NOT IN ('other', 'unknown') AND a.tool_type <> b.tool_type) AS conflict
    FROM fused f JOIN environments a ON a.story_id = f.query_id JOIN environments b ON b.story_id = f.story_id),
rescored AS (SELECT *, round(env::DOUBLE, 4) AS environment_score FROM compared)
SELECT query_id, story_id, environment_score, round(round(greatest(0, similarity - (1 - (environment_score + 1) / 2) * 0.0001 * 0.08), 8), 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, environment_score DESC, similarity DESC, rank) AS place FROM rescored"""

SQL = {
    "vector_topk": f"WITH {_PAIRS}, {VECTOR_LANE} SELECT * FROM vector_lane WHERE rank <= 3 AND similarity >= 0.5",
    "cosine_project_topk": f"WITH {_PAIRS}, {VECTOR_LANE} SELECT query_id, story_id, round(dot / norm, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY dot / norm DESC, story_id) AS rank FROM vector_all WHERE same QUALIFY rank <= 5",
    "lexical_topk": f"WITH {_PAIRS}, {QUERIES_SQL}, {LEXICAL_LANE} SELECT * FROM lexical_lane",
    "bm25_topk": rf"""WITH {_PAIRS}, {QUERIES_SQL}, {TERMS},
tokens AS (SELECT story_id, unnest(regexp_extract_all(title, '[a-z0-9_]+')) AS term, 8.0 AS w FROM folded UNION ALL SELECT story_id, unnest(regexp_extract_all(abstract, '[a-z0-9_]+')), 5.0 FROM folded
    UNION ALL SELECT story_id, unnest(regexp_extract_all(content, '[a-z0-9_]+')), 2.0 FROM folded UNION ALL SELECT story_id, unnest(regexp_extract_all(keywords, '[a-z0-9_]+')), 5.0 FROM folded),
postings AS (SELECT story_id, term, sum(w)::DOUBLE AS tf FROM tokens GROUP BY ALL), lengths AS (SELECT story_id, count(*) AS length FROM tokens GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
size AS (SELECT (SELECT count(*) FROM stories) AS n, (SELECT avg(length) FROM lengths) AS mean),
scored AS (SELECT query_id, story_id, round(sum(greatest(0.000001, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25
    FROM query_terms JOIN postings USING (term) JOIN df USING (term) JOIN lengths USING (story_id), size GROUP BY query_id, story_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, story_id) AS rank, bm25 FROM scored QUALIFY rank <= 10""",
    "hybrid_rrf": f"WITH {_PAIRS}, {FUSED} SELECT * REPLACE (round(fusion, 6) AS fusion) FROM fused",
    "hybrid_gate": f"""WITH {_PAIRS}, {FUSED}, facts AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN coalesce(vector_similarity, lexical_similarity, similarity) END) AS conf,
    round(max(CASE WHEN rank = 1 THEN fusion END) - max(CASE WHEN rank = 2 THEN fusion END), 8) AS gap FROM fused GROUP BY query_id),
tests AS (SELECT q.query_id, coalesce(n, 0) = 0 AS zero, coalesce(conf < 0.62, false) AS low, coalesce(n > 1 AND gap <= 0.035, false) AS ambiguous,
    length(text) >= 80 OR len(regexp_extract_all(lower(text), '\\b(?:and|or|then|also|but)\\b')) >= 2 AS compound FROM queries q LEFT JOIN facts USING (query_id))
SELECT query_id, array_to_string(list_filter([CASE WHEN zero THEN 'zero_results' END, CASE WHEN low THEN 'low_confidence' END, CASE WHEN ambiguous THEN 'ambiguous_ranking' END, CASE WHEN compound THEN 'long_compound_query' END], lambda x: x IS NOT NULL), ',') AS reasons,
    array_to_string(list_filter([CASE WHEN compound OR ambiguous THEN 'multi_query' END, CASE WHEN zero OR low THEN 'hyde' END], lambda x: x IS NOT NULL), ',') AS transforms FROM tests""",
    "transform_merge": f"""WITH {_PAIRS}, {FUSED}, lanes AS (SELECT query_id, 1 AS ranking, story_id, similarity, rank FROM vector_lane WHERE rank <= {K} AND similarity >= 0.5 UNION ALL SELECT query_id, 2, story_id, similarity, rank FROM lexical_lane),
most AS (SELECT query_id, count(DISTINCT ranking) / 61.0::DOUBLE AS most FROM lanes GROUP BY query_id),
votes AS (SELECT query_id, story_id, sum(1.0::DOUBLE / (60 + rank)) AS votes, max(similarity) AS t_score, arg_min(similarity, ranking) AS first FROM lanes GROUP BY ALL),
signal AS (SELECT query_id, story_id, 0.6 * votes / most + 0.4 * t_score AS signal, first FROM votes JOIN most USING (query_id)),
merged AS (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.story_id, s.story_id) AS story_id, round(least(1.0, greatest(0.0, 1 - (1 - coalesce(fusion, first)) * (1 - 0.35 * coalesce(signal, 0)))), 8) AS fusion
    FROM (SELECT * FROM fused WHERE rank <= 10) f FULL JOIN signal s ON f.query_id = s.query_id AND f.story_id = s.story_id)
SELECT query_id, story_id, round(fusion, 6) AS fusion, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, story_id) AS rank FROM merged QUALIFY rank <= 10""",
    "environment_rerank": f"SELECT query_id, story_id, environment_score, score, place AS rank FROM ({_ENV}) WHERE place <= 10",
    "strict_scope": f"SELECT query_id, story_id, environment_score, score, place AS rank FROM ({_ENV} WHERE NOT conflict) WHERE place <= 10",
    "rerank_overlap": rf"""WITH {_PAIRS}, {FUSED}, head AS (SELECT * FROM fused WHERE rank <= 8),
all_terms AS (SELECT DISTINCT query_id, term FROM query_tokens), docs AS (SELECT story_id, regexp_extract_all(concat(title, ' ', abstract, ' ', content, ' ', keywords), '[a-z0-9_]+') AS d FROM folded),
pairs AS (SELECT h.query_id, h.story_id, h.fusion, h.rank, t.term, coalesce(list_contains(d, t.term), false) AS held, max(h.rank) OVER (PARTITION BY h.query_id) AS n FROM head h JOIN docs USING (story_id) LEFT JOIN all_terms t ON t.query_id = h.query_id),
weighed AS (SELECT *, 1 + ln((n + 1) / (sum(held::INT) OVER (PARTITION BY query_id, term) + 1)) AS idf FROM pairs),
rescored AS (SELECT query_id, story_id, rank AS old, round(least(1.0, 0.5 * fusion + 0.5 * coalesce(sum(CASE WHEN held THEN idf ELSE 0 END) / sum(CASE WHEN term IS NOT NULL THEN idf END), 0)), 8) AS score, 0 AS part FROM weighed GROUP BY query_id, story_id, fusion, rank
    UNION ALL SELECT query_id, story_id, rank, fusion, 1 FROM fused WHERE rank > 8)
SELECT query_id, story_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY part, CASE WHEN part = 0 THEN -score ELSE 0 END, old) AS rank FROM rescored""",
    "briefing_budget": rf"""WITH {_PAIRS}, {VECTOR_LANE}, cut AS (SELECT query_id, story_id, rank, title, rtrim(substr(regexp_replace(abstract, '\s+', ' ', 'g'), 1, 140)) AS excerpt FROM vector_lane JOIN stories USING (story_id) WHERE rank <= 5 AND similarity >= 0.6),
costed AS (SELECT *, CAST(ceil(length(concat(title, ' ', excerpt)) / 4.0) AS BIGINT) AS tokens FROM cut)
SELECT query_id, story_id, rank, excerpt, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM costed) WHERE total <= 2000""",
    "lexical_terms": r"""WITH t AS (SELECT doc_id, text, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+')) AS term, generate_subscripts(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+'), 1) AS place FROM documents),
firsts AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) AS n FROM t GROUP BY doc_id, term)
SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY n) FILTER (WHERE n <= 8), '') AS terms, coalesce(string_agg(term, ' ' ORDER BY term), '') AS rerank_terms, CAST(ceil(length(any_value(d.text)) / 4.0) AS BIGINT) AS tokens
FROM documents d LEFT JOIN firsts USING (doc_id) GROUP BY d.doc_id""",
}

QUERIES = {name: globals()[name] for name in SQL}

"""Hybrid recall: fuse ranked lanes, gate, merge expanded queries, rerank, trim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from engram.functions import context as C
from engram.functions import text as T
from engram.operators.lexical import lexical_topk
from engram.operators.vector import vector_topk
from engram.params import DEFAULTS, Params

def _by_query() -> WindowSpec:
    return Window.partitionBy("query_id")



def ranked(df: DataFrame, *order: Column | str, k: int | None = None, name: str = "rank") -> DataFrame:
    """A dense order per query; with k only the first k, which Spark prunes before the shuffle."""
    out = df.withColumn(name, F.row_number().over(_by_query().orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def vector_lane(queries: DataFrame, stories: DataFrame, k: int, floor: float) -> DataFrame:
    """The k best stories of every query whose similarity is `floor` or more; what is below a floor above 0 isn't gathered."""
    return vector_topk(queries, stories, k, least=floor) if floor > 0 else vector_topk(queries, stories, k).filter(F.col("similarity") >= floor)


def reciprocal_fusion(vector: DataFrame, lexical: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    """query_id, story_id, vector_similarity, lexical_similarity, rrf, fusion, similarity, lane, rank of two lanes.

    vector: query_id, story_id, similarity. lexical: with lexical_score besides. In a lane, equal scores share the rank
    of their first. Lanes of a query that have rows make up the normaliser.
    """
    tied = lambda score: F.rank().over(_by_query().orderBy(F.desc(score)))
    v = vector.select("query_id", "story_id", F.col("similarity").alias("v_sim"), tied("similarity").alias("v_rank"))
    x = lexical.select("query_id", "story_id", F.col("similarity").alias("l_sim"), tied("lexical_score").alias("l_rank"))
    both = v.join(x.hint("merge"), ["query_id", "story_id"], "full_outer")
    wv, wl, c = params.weight_vector, params.weight_lexical, params.rrf_k
    part = lambda rank, w: F.coalesce(F.lit(w) / (c + F.col(rank)), F.lit(0.0))
    lanes = F.max(F.col("v_rank").isNotNull().cast("int")).over(_by_query()) * F.lit(wv / (c + 1)) + F.max(F.col("l_rank").isNotNull().cast("int")).over(_by_query()) * F.lit(wl / (c + 1))
    rrf = F.least(F.lit(1.0), (part("v_rank", wv) + part("l_rank", wl)) / lanes)
    v_sim, l_sim = F.coalesce("v_sim", F.lit(0.0)), F.coalesce("l_sim", F.lit(0.0))
    confidence = F.greatest(v_sim, 0.9 * l_sim)
    lane = F.when(F.col("v_rank").isNotNull() & F.col("l_rank").isNotNull(), "hybrid").when(F.col("v_rank").isNotNull(), "vector").otherwise("lexical")
    out = both.withColumn("rrf", rrf).select(
        "query_id", "story_id", F.col("v_sim").alias("vector_similarity"), F.col("l_sim").alias("lexical_similarity"), F.round("rrf", 6).alias("rrf"),
        F.round(F.least(F.lit(1.0), 0.68 * confidence + 0.32 * F.col("rrf")), 8).alias("fusion"), F.round(F.when(v_sim > 0, v_sim).otherwise(l_sim), 4).alias("similarity"), lane.alias("lane"),
    )
    return ranked(out, F.desc("fusion"), F.desc("similarity"), "story_id", k=k)


def gate(queries: DataFrame, fused: DataFrame, params: Params = DEFAULTS, conjunctions: str = r"(?i)\b(and|or|then|also|but)\b|以及|并且|同时|然后") -> DataFrame:
    """query_id, reasons, transforms: which queries are worth a second stage, and what to try, two at most."""
    top = F.max(F.when(F.col("rank") == 1, F.coalesce("vector_similarity", "lexical_similarity", "similarity")))
    facts = fused.groupBy("query_id").agg(F.count("*").alias("n"), top.alias("confidence"), (F.max(F.when(F.col("rank") == 1, F.col("fusion"))) - F.max(F.when(F.col("rank") == 2, F.col("fusion")))).alias("gap"))
    q = queries.select("query_id", "text").join(facts.hint("merge"), "query_id", "left")
    n, low = F.coalesce("n", F.lit(0)), F.coalesce(F.col("confidence") < params.gate_confidence, F.lit(False))
    compound = (F.length("text") >= params.gate_chars) | (F.size(F.regexp_extract_all("text", F.lit(f"({conjunctions})"), 1)) >= 2)
    ambiguous = F.coalesce((n > 1) & (F.round("gap", 8) <= params.gate_gap), F.lit(False))
    cross = F.col("text").rlike(f"[{T.CJK}]") & F.col("text").rlike("[A-Za-z]") & ((n == 0) | low)
    named = [("zero_results", n == 0), ("low_confidence", low), ("ambiguous_ranking", ambiguous), ("long_compound_query", compound), ("cross_language", cross)]
    plans = [("rewrite", cross), ("multi_query", compound | ambiguous), ("hyde", (n == 0) | low)]
    pick = lambda items: F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in items)))
    return q.select("query_id", pick(named).alias("reasons"), F.slice(pick(plans), 1, params.gate_transforms).alias("transforms"))


def merge_transformed(base: DataFrame, transformed: DataFrame, k: int, weight: float = DEFAULTS.weight_transform_auto, params: Params = DEFAULTS) -> DataFrame:
    """Merge rankings of expanded queries into the base ranking: query_id, story_id, fusion, rank.

    base: query_id, story_id, fusion. transformed: query_id, ranking (its number), story_id, fusion, rank. A story that
    the base lacks starts from its score in the first ranking that has it.
    """
    c = params.rrf_k
    present = transformed.select("query_id", "ranking").distinct().groupBy("query_id").agg((F.count("*") / F.lit(float(c + 1))).alias("most"))
    votes = transformed.groupBy("query_id", "story_id").agg(F.sum(F.lit(1.0) / (c + F.col("rank"))).alias("votes"), F.max("fusion").alias("t_score"), F.min_by("fusion", "ranking").alias("first"))
    signal = votes.join(present.hint("merge"), "query_id").select("query_id", "story_id", (0.6 * F.col("votes") / F.col("most") + 0.4 * F.col("t_score")).alias("signal"), "first")
    both = base.select("query_id", "story_id", F.col("fusion").alias("base")).join(signal.hint("merge"), ["query_id", "story_id"], "full_outer")
    start = F.coalesce("base", "first")
    fused = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (1 - start) * (1 - weight * F.coalesce("signal", F.lit(0.0))))), 8)
    return ranked(both.select("query_id", "story_id", fused.alias("fusion")), F.desc("fusion"), "story_id", k=k)


def environment_rerank(hits: DataFrame, environments: DataFrame, current: DataFrame, k: int, strict: bool = False, params: Params = DEFAULTS) -> DataFrame:
    """Break ties of hits (query_id, story_id, similarity, fusion, rank) by the environment they were seen in.

    environments: a row per story and environment (the five fields, place). current: a row per query with the same
    fields in `now`. A story counts with its best environment. strict drops stories all of whose environments conflict.
    Returns query_id, story_id, environment_score, score, rank.
    """
    fields = list(C.FIELDS)
    seen = hits.join(environments.select("story_id", F.struct(*fields).alias("env")).hint("merge"), "story_id", "left").join(current.select("query_id", "now").hint("merge"), "query_id", "left")
    compared = seen.withColumn("c", C.environment_compare(F.col("now"), F.col("env")))
    per_story = compared.groupBy("query_id", "story_id", "similarity", "fusion", "rank").agg(
        F.max(F.when(F.col("env").isNotNull() & F.col("now").isNotNull(), F.col("c.score"))).alias("best"),
        F.min(F.when(F.col("env").isNotNull(), (F.size("c.conflicts") > 0).cast("int"))).alias("all_conflict"),
        F.max(F.col("now").isNotNull().cast("int")).alias("known"),
    )
    env = F.round(F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "best")), F.lit(0.0)), 4)
    score = F.when(F.col("known") == 0, F.round("similarity", 4)).otherwise(C.environment_rank_score(F.col("similarity"), F.col("environment_score"), params.environment_weight))
    out = per_story.withColumn("environment_score", env).withColumn("score", score)
    if strict:
        out = out.filter(F.coalesce(F.col("all_conflict") == 0, F.lit(True)))
    out = out.withColumnRenamed("rank", "old_rank")
    return ranked(out, F.desc("fusion"), F.desc("environment_score"), F.desc("similarity"), "old_rank", k=k).select("query_id", "story_id", "environment_score", "score", "rank")


def overlap_rerank(queries: DataFrame, hits: DataFrame, stories: DataFrame, head: int = DEFAULTS.rerank_top) -> DataFrame:
    """Rerank the first `head` hits by the share of the query's rare terms that a story holds; the tail stays.

    hits: query_id, story_id, fusion, rank. Only stories of the head are read. Returns query_id, story_id, score, rank.
    """
    first, tail = hits.filter(F.col("rank") <= head), hits.filter(F.col("rank") > head)
    document = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in ("title", "abstract", "content", "keywords")))
    texts = stories.join(first.select("story_id").distinct().hint("merge"), "story_id", "left_semi").select("story_id", T.rerank_terms(document).alias("d_terms"))
    q = queries.select("query_id", T.rerank_terms(T.query_focus(F.col("text"))).alias("terms"))
    pairs = first.join(texts.hint("merge"), "story_id", "left").join(q.hint("merge"), "query_id")
    terms = pairs.select("query_id", "story_id", "fusion", "rank", F.explode_outer("terms").alias("term"), "d_terms").withColumn("held", F.coalesce(F.array_contains("d_terms", F.col("term")), F.lit(False)))
    terms = terms.drop("d_terms").withColumn("df", F.sum(F.col("held").cast("int")).over(Window.partitionBy("query_id", "term"))).withColumn("n", F.max("rank").over(_by_query()))
    idf = 1 + F.log((F.col("n") + 1) / (F.col("df") + 1))
    scored = terms.groupBy("query_id", "story_id", "fusion", "rank").agg(F.sum(F.when(F.col("held"), idf).otherwise(0.0)).alias("got"), F.sum(F.when(F.col("term").isNotNull(), idf).otherwise(0.0)).alias("all"))
    overlap = F.when(F.col("all") > 0, F.col("got") / F.col("all")).otherwise(0.0)
    top = scored.select("query_id", "story_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col("fusion") + 0.5 * overlap)), 8).alias("score"), F.col("rank").alias("old_rank"), F.lit(0).alias("part"))
    rest = tail.select("query_id", "story_id", F.col("fusion").alias("score"), F.col("rank").alias("old_rank"), F.lit(1).alias("part"))
    order = [F.col("part"), F.when(F.col("part") == 0, -F.col("score")).otherwise(F.lit(0.0)), F.col("old_rank")]
    return ranked(top.unionByName(rest), *order).select("query_id", "story_id", "score", "rank")


def recall(queries: DataFrame, stories: DataFrame, k: int, params: Params = DEFAULTS) -> DataFrame:
    """Hybrid recall of a table of queries. A query without a vector is answered by the lexical lane alone."""
    wide = max(4 * k, k, min(64, params.rerank_top))
    return reciprocal_fusion(vector_lane(queries, stories, wide, params.sim_search), lexical_topk(queries, stories, wide), k, params)


def briefing(hits: DataFrame, stories: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The longest prefix of a query's best hits whose excerpts fit the token budget: query_id, story_id, rank, excerpt, tokens."""
    best = hits.filter((F.col("similarity") >= params.briefing_similarity) & (F.col("rank") <= params.briefing_top))
    text = F.when(F.coalesce("abstract", F.lit("")) != "", F.col("abstract")).otherwise(F.col("content"))
    cut = best.join(stories.select("story_id", "title", T.cut(F.regexp_replace(text, r"\s+", " "), params.briefing_excerpt).alias("excerpt")).hint("merge"), "story_id")
    cost = cut.withColumn("tokens", T.estimate_tokens(F.concat_ws(" ", "title", "excerpt")))
    total = F.sum("tokens").over(_by_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return cost.withColumn("total", total).filter(F.col("total") <= params.briefing_tokens).select("query_id", "story_id", "rank", "excerpt", "tokens")

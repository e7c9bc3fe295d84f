"""Which strategy of retrieval should be the default, and what the graph adds to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.fusion import ranked


def strategy_results(runs: dict[str, DataFrame], cases: DataFrame) -> DataFrame:
    """strategy, recall_3, mrr, hard_recall_3, hard_mrr, n: a row per run.

    runs: by name, query_id, story_id, rank. cases: query_id, story_id (the right one), hard. A case without results, or
    whose story isn't found, scores zero. Means are rounded to 6 digits.
    """
    names = list(runs)
    found = None
    for name in names:
        run = runs[name].select(F.lit(name).alias("strategy"), "query_id", "story_id", "rank")
        found = run if found is None else found.unionByName(run)
    first = found.join(cases.select("query_id", "story_id").hint("merge"), ["query_id", "story_id"], "left_semi").groupBy("query_id").pivot("strategy", names).agg(F.min("rank"))
    every = cases.select("query_id", "hard").join(first.hint("merge"), "query_id", "left")
    rows = every.select("hard", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(n).alias("first")) for n in names))).alias("x")).select("hard", "x.*")
    hit, reciprocal = F.when(F.col("first") <= 3, 1.0).otherwise(0.0), F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    mean = lambda c, only=None: F.round(F.coalesce(F.avg(c if only is None else F.when(only, c)), F.lit(0.0)), 6)
    return rows.groupBy("strategy").agg(mean(hit).alias("recall_3"), mean(reciprocal).alias("mrr"), mean(hit, F.col("hard")).alias("hard_recall_3"), mean(reciprocal, F.col("hard")).alias("hard_mrr"), F.count("*").alias("n"))


def strategy_gates(results: DataFrame, baseline: str, transformed: Sequence[str] = (), evidence: str = "live_generated") -> DataFrame:
    """results with hard_quality_gain, overall_non_regression, latency, ground_truth_isolation, online_latency_evidence,
    eligible and selected.

    results: a row per strategy, as strategy_results gives it, and p95_ms. A strategy must find .10 more of the hard cases
    than the baseline (where that finds .90 of them, have .05 more of the reciprocal rank), lose no more than .02 over all,
    and answer within a second, or five if its queries are transformed, which must happen while it is measured. The best
    eligible one is selected (hard recall, hard reciprocal rank, recall, then speed; ties by name), else the baseline.
    """
    of = lambda c: F.max(F.when(F.col("strategy") == baseline, F.col(c))).over(Window.partitionBy(F.lit(0)))  # noqa: E731  (a few rows: one per strategy)
    deep = F.col("strategy").isin(*transformed)
    more = lambda c, least: F.round(F.col(c) - of(c), 6) >= least
    judged = results.withColumns({
        "hard_quality_gain": F.when(of("hard_recall_3") >= 0.90, more("hard_mrr", 0.05)).otherwise(more("hard_recall_3", 0.10)),
        "overall_non_regression": more("recall_3", -0.02),
        "latency": F.col("p95_ms") <= F.when(deep, 5000.0).otherwise(1000.0),
        "ground_truth_isolation": ~deep | F.lit(evidence != "oracle_upper_bound"),
        "online_latency_evidence": ~deep | F.lit(evidence == "live_generated"),
    })
    passed = F.col("hard_quality_gain") & F.col("overall_non_regression") & F.col("latency") & F.col("ground_truth_isolation") & F.col("online_latency_evidence")
    judged = judged.withColumn("eligible", (F.col("strategy") != baseline) & F.coalesce(passed, F.lit(False)))
    order = [F.desc("eligible"), F.when(~F.col("eligible"), F.col("strategy") != baseline), F.desc("hard_recall_3"), F.desc("hard_mrr"), F.desc("recall_3"), "p95_ms", "strategy"]
    return judged.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) == 1)


def graph_ranks(hits: DataFrame, paths: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """query_id, story_id, before, after: the rank of a case's target among the first k, without and with the graph.

    hits: query_id, story_id, similarity, rank. paths: seed, node, score of what is reached from hits. targets: query_id,
    story_id, several a query if need be. A story counts with its best score, a reached one with its path's score times
    the similarity of the seed (8 digits); ties go to the smaller story_id. Null where the target isn't among them.
    """
    reached = hits.select("query_id", F.col("story_id").alias("seed"), "similarity").join(paths.select("seed", "node", "score").hint("merge"), "seed")
    both = hits.select("query_id", "story_id", F.col("similarity").cast("double").alias("score")).unionByName(reached.select("query_id", F.col("node").alias("story_id"), F.round(F.col("similarity") * F.col("score"), 8).alias("score")))
    after = ranked(both.groupBy("query_id", "story_id").agg(F.max("score").alias("score")), F.desc("score"), "story_id", k=k, name="after")
    out = targets.select("query_id", "story_id").join(hits.filter(F.col("rank") <= k).select("query_id", "story_id", F.col("rank").alias("before")).hint("merge"), ["query_id", "story_id"], "left")
    return out.join(after.drop("score").hint("merge"), ["query_id", "story_id"], "left")

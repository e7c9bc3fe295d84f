"""Evaluation of rankings, branches and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.sources.stage_tables import materialize

#: Slices that the distinct values of a group are dealt to.
SLICES = 64


def recall_metrics(ranked: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Per query: recall@k, precision@k (of what was returned) and the reciprocal rank of the first right story.

    ranked: query_id, story_id, rank. qrels: query_id, story_id. A query without results scores zero.
    """
    wanted = qrels.groupBy("query_id").agg(F.count("*").alias("n_right"))
    hits = ranked.join(qrels.select("query_id", "story_id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "story_id"], "left").fillna(0, ["hit"])
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks] + [F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks]
    per = hits.groupBy("query_id").agg(*sums, F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    out = wanted.join(per.hint("merge"), "query_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select("query_id", *(zero(F.col(f"h{k}") / F.col("n_right")).alias(f"recall_{k}") for k in ks), *(zero(F.when(F.col(f"n{k}") > 0, F.col(f"h{k}") / F.col(f"n{k}"))).alias(f"precision_{k}") for k in ks), zero(1.0 / F.col("first")).alias("mrr"))


def means(metrics: DataFrame, variant: str, columns: Sequence[str]) -> DataFrame:
    """Means per variant and over all (variant null)."""
    return metrics.rollup(variant).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns), F.count("*").alias("n"))


def threshold_sweep(ranked: DataFrame, qrels: DataFrame, thresholds: Sequence[float], k: int = 3) -> DataFrame:
    """threshold, recall, returned: recall@k and mean number of results at each similarity threshold, in one pass."""
    n = qrels.select("query_id").distinct().agg(F.count("*").alias("n_queries"))
    at = ranked.filter(F.col("rank") <= k).join(qrels.select("query_id", "story_id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "story_id"], "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("similarity") >= F.col("threshold"))
    sums = at.groupBy("threshold").agg(F.sum("hit").alias("hits"), F.count("*").alias("shown"))
    grid = ranked.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return F.broadcast(grid).join(sums, "threshold", "left").crossJoin(F.broadcast(n)).select("threshold", F.coalesce(F.col("hits") / F.col("n_queries"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("shown") / F.col("n_queries"), F.lit(0.0)).alias("returned"))


def branch(similarity, high: float, update_only: float):
    """create, merge or update, by the similarity to the nearest story."""
    return F.when(similarity >= update_only, "update").when(similarity >= high, "merge").otherwise("create")


def branch_accuracy(pairs: DataFrame) -> DataFrame:
    """expected (null: all), accuracy, n."""
    return pairs.rollup("expected").agg(F.avg((F.col("actual") == F.col("expected")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def order_statistics(rows: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """The groups, and for each share i: at_i = (n-1) * share, low_i and high_i, the elements at its floor and ceiling.

    Equal values are counted first; the distinct ones of a group are dealt to slices by approximate quantiles, and only a
    slice is sorted in one task. The result is exact whatever the approximation. Null values don't count; a group that has
    nothing else gives nulls.
    """
    counts = materialize(rows.groupBy(F.struct(*groups).alias("g"), F.col(value).alias("value")).agg(F.count(value).alias("n")), "values")
    edges = counts.groupBy("g").agg(F.sum("n").alias("total"), F.percentile_approx("value", [i / SLICES for i in range(1, SLICES)], 1000).alias("edges"))
    dealt = counts.join(materialize(edges, "edges"), "g").withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    held = dealt.groupBy("g", "slice").agg(F.sum("n").alias("n")).groupBy("g").agg(F.collect_list(F.struct("slice", "n")).alias("held"))
    ahead = F.aggregate(F.filter("held", lambda h: h["slice"] < F.col("slice")), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    within = F.sum("n").over(Window.partitionBy("g", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.join(materialize(held, "slices"), "g").withColumn("first", ahead + F.coalesce(within, F.lit(0)))
    at = [(F.col("total") - 1) * F.lit(share) for share in shares]
    element = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("first") + F.col("n")), F.col("value")))
    found = [c for i, x in enumerate(at) for c in (F.max(x).alias(f"at_{i}"), element(F.floor(x)).alias(f"low_{i}"), element(F.ceil(x)).alias(f"high_{i}"))]
    return placed.groupBy("g").agg(*found).select("g.*", *(f"{name}_{i}" for i in range(len(shares)) for name in ("at", "low", "high")))


def percentiles(rows: DataFrame, stages: Sequence[str], by: str | None = None) -> DataFrame:
    """stage (and group), p50, p95, p99 by linear interpolation, rounded to 3 digits."""
    groups = [*([by] if by else []), "stage"]
    long = rows.select(*([by] if by else []), F.explode(F.map_from_arrays(F.array(*map(F.lit, stages)), F.array(*(F.col(s).cast("double") for s in stages)))).alias("stage", "ms"))
    p = lambda i: F.round(F.coalesce(F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * (F.col(f"at_{i}") - F.floor(f"at_{i}")), F.lit(0.0)), 3)
    return order_statistics(long, groups, "ms", (0.5, 0.95, 0.99)).select(*groups, *(p(i).alias(name) for i, name in enumerate(("p50", "p95", "p99"))))


def lower_percentile(rows: DataFrame, value: str, share: float, by: str) -> DataFrame:
    """The element at floor((n-1) * share) of the sorted values: the other definition in use. Groups without values go."""
    return order_statistics(rows, [by], value, [share]).filter("low_0 is not null").select(by, F.col("low_0").alias(value))


def ratios(rows: DataFrame, by: str) -> DataFrame:
    """Shares of cache hits, fallbacks and degraded answers, and of degraded fallbacks (null without any)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy(by).agg(share("cache_hit").alias("cache_hit"), share("fallback").alias("fallback"), share("degraded").alias("degraded"), F.avg(F.when(F.col("fallback"), (~F.col("degraded")).cast("double"))).alias("fallback_success"), F.count("*").alias("n"))


def last_n(rows: DataFrame, n: int, by: str, at: str, tie: str) -> DataFrame:
    """The n latest rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))).filter(F.col("place") <= n).drop("place")

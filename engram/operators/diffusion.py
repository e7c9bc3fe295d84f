"""Budgeted multi-hop diffusion with explained paths.

A hop is a fixed chain of a join and windows: neighbours of the frontier, policy, fan-out per state, order, path budget,
dominance, token budget. The order of expansion is total, so that running maxima and sums over it do what a sequential
walk does. The driver only counts hops; every hop is written as a table, which cuts the plan and survives executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import graph
from engram.params import DEFAULTS, Params
from engram.sources.stage_tables import materialize

TERMINAL = ("co_recall", "sibling")
_STEP = "struct<edge_id:bigint,edge_type:string,direction:string,node:bigint>"


def diffuse(seeds: DataFrame, edges: DataFrame, stories: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Candidates that paths from a query's seeds lead to: query_id, story_id, score, seed, hop, path, tokens.

    seeds: query_id, story_id, similarity. stories: story_id, abstract (active ones; others are not entered). Budgets
    per query: params.hops, paths, fan_out (edges per state) and tokens. Scores are the seed's similarity times edge,
    type and direction factors, a hub penalty by the neighbour's degree, and a decay per hop. A query whose token budget
    overflows takes nothing from there on. Superseded stories are removed at the end.
    """
    steps = graph.both_ways(edges).filter(graph.can_traverse(F.col("edge_type"), F.col("direction")))
    degree = graph.degrees(edges)
    hub = F.lit(1.0) / F.sqrt(F.greatest(F.lit(1.0), F.col("degree") / F.lit(float(params.fan_out))))
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")) * graph.type_factor(F.col("edge_type"), params) * graph.direction_factor(F.col("edge_type"), F.col("direction"))
    active = stories.select(F.col("story_id").alias("neighbor"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    steps = steps.join(degree.withColumnRenamed("node", "neighbor").hint("merge"), "neighbor").join(active.hint("merge"), "neighbor")
    steps = materialize(steps.select("node", "neighbor", "edge_id", "edge_type", "direction", "weight", factor.alias("factor"), hub.alias("hub"), "abstract"), "diffusion-steps")

    seed_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "story_id"))
    front = seeds.select(
        "query_id", F.col("story_id").alias("seed"), F.col("story_id").alias("node"), F.col("similarity").alias("base"), F.lit(1.0).alias("product"), F.lit(1.0).alias("hubs"), F.col("similarity").alias("state_score"),
        F.expr(f"cast(array() as array<{_STEP}>)").alias("path"), F.array("story_id").alias("visited"), F.expr("cast(array() as array<string>)").alias("types"), seed_rank.alias("state"),
    )
    front = materialize(front, "diffusion-front")
    query_seeds = front.groupBy("query_id").agg(F.collect_set("node").alias("seeds"))
    spent = front.select("query_id").distinct().select("query_id", F.lit(0).cast("long").alias("paths"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("stopped"))
    best = None  # query_id, seed, node, score so far
    kept = None  # candidates so far
    by_query = Window.partitionBy("query_id")
    for hop in range(1, params.hops + 1):
        reached = front.join(spent.filter(~F.col("stopped")), "query_id").join(steps, "node")
        kind = F.col("edge_type")
        allowed = F.when(kind.isin(*TERMINAL), F.lit(hop == 1)).otherwise(True) & ~F.arrays_overlap("types", F.array(*map(F.lit, TERMINAL)))
        allowed = allowed & ~(kind.isin("same_environment", "supersedes") & F.array_contains("types", kind))
        fan = F.row_number().over(Window.partitionBy("query_id", "state").orderBy(F.desc("weight"), "edge_id"))
        reached = reached.filter(allowed).withColumn("fan", fan).filter(F.col("fan") <= params.fan_out)
        reached = reached.filter(~F.array_contains("visited", F.col("neighbor")))
        order = Window.partitionBy("query_id").orderBy("state", "fan")
        reached = reached.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") + F.col("paths") <= params.paths)
        reached = reached.withColumns({"product": F.col("product") * F.col("factor"), "hubs": F.col("hubs") * F.col("hub")})
        reached = reached.withColumn("score", F.col("base") * F.col("product") * F.col("hubs") * F.lit(params.hop_decay ** (hop - 1)))
        reached = materialize(reached.withColumn("n_paths", F.max("ord").over(by_query)).select("query_id", "seed", F.col("neighbor").alias("node"), "base", "product", "hubs", "score", "path", "visited", "types", "edge_id", "edge_type", "direction", "abstract", "ord", "n_paths", "paths", "tokens"), "diffusion-reached")
        good = reached.filter(F.col("score") >= params.least_score)
        if best is not None:
            good = good.join(best.withColumnRenamed("score", "before"), ["query_id", "seed", "node"], "left")
        else:
            good = good.withColumn("before", F.lit(None).cast("double"))
        earlier = Window.partitionBy("query_id", "seed", "node").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        good = good.withColumn("seen", F.greatest("before", F.max("score").over(earlier))).filter(F.col("seen").isNull() | (F.col("score") > F.col("seen")))
        step = F.struct("edge_id", "edge_type", "direction", "node")
        good = good.withColumn("path", F.concat("path", F.array(step))).join(query_seeds, "query_id").withColumn("is_seed", F.array_contains("seeds", F.col("node"))).drop("seeds")
        good = good.withColumn("cost", T.graph_token_cost(F.col("abstract"), F.size("path")))
        if kept is not None:
            good = good.join(kept.select("query_id", F.col("story_id").alias("node"), F.col("score").alias("old_score"), F.col("tokens").alias("old_cost")), ["query_id", "node"], "left")
        else:
            good = good.withColumns({"old_score": F.lit(None).cast("double"), "old_cost": F.lit(None).cast("long")})
        # a node's candidate is replaced by a better one; what it costs more counts against the budget
        by_node = Window.partitionBy("query_id", "node").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        rounded = F.round("score", 8)
        good = good.withColumn("best_before", F.greatest("old_score", F.max(F.when(~F.col("is_seed"), rounded)).over(by_node)))
        good = good.withColumn("takes", ~F.col("is_seed") & (F.col("best_before").isNull() | (rounded > F.col("best_before"))))
        held = F.last(F.when(F.col("takes"), F.col("cost")), ignorenulls=True).over(by_node)
        good = good.withColumn("delta", F.when(F.col("takes"), F.col("cost") - F.coalesce(held, "old_cost", F.lit(0))).otherwise(F.lit(0)))
        running = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        good = good.withColumn("total", F.col("tokens") + F.sum("delta").over(running))
        good = good.withColumn("over", F.col("takes") & (F.col("total") > params.tokens)).withColumn("stop_at", F.min(F.when(F.col("over"), F.col("ord"))).over(by_query))
        good = materialize(good.filter(F.col("stop_at").isNull() | (F.col("ord") <= F.col("stop_at"))), "diffusion-good")
        stop = good.filter("ord = stop_at").select("query_id").distinct().withColumn("stop", F.lit(True))
        good = good.filter("stop_at is null or ord < stop_at")
        new = good.filter("takes").select("query_id", F.col("node").alias("story_id"), rounded.alias("score"), "seed", F.lit(hop).alias("hop"), "path", F.col("cost").alias("tokens"), "ord")
        last = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "story_id").orderBy(F.desc("ord")))).filter("n = 1").drop("n", "ord")
        kept = last if kept is None else last.unionByName(kept.join(last.select("query_id", "story_id"), ["query_id", "story_id"], "left_anti"))
        kept = materialize(kept, "diffusion-kept")
        now = good.groupBy("query_id", "seed", "node").agg(F.max("score").alias("score"))
        best = now if best is None else now.unionByName(best.join(now.select("query_id", "seed", "node"), ["query_id", "seed", "node"], "left_anti"))
        best = materialize(best, "diffusion-best")
        used = reached.groupBy("query_id").agg(F.max("n_paths").alias("more"))
        took = good.groupBy("query_id").agg(F.sum("delta").alias("cost"))
        spent = spent.join(used, "query_id", "left").join(took, "query_id", "left").join(stop, "query_id", "left")
        spent = materialize(spent.select("query_id", (F.col("paths") + F.coalesce("more", F.lit(0))).alias("paths"), (F.col("tokens") + F.coalesce("cost", F.lit(0))).alias("tokens"), (F.col("stopped") | F.coalesce("stop", F.lit(False)) | (F.col("paths") + F.coalesce("more", F.lit(0)) >= params.paths)).alias("stopped")), "diffusion-spent")
        state = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
        front = materialize(good.select("query_id", "seed", "node", "base", "product", "hubs", F.col("score").alias("state_score"), "path", F.concat("visited", F.array("node")).alias("visited"), F.concat("types", F.array("edge_type")).alias("types"), state.alias("state")), "diffusion-front")
    gone = graph.superseded(edges, stories)
    return kept.join(gone, "story_id", "left_anti")


def merge(direct: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Direct and graph hits as one ranking: query_id, story_id, score, similarity, lane, rank; direct wins ties.

    direct: query_id, story_id, fusion, similarity.
    """
    both = direct.select("query_id", "story_id", F.col("fusion").alias("score"), "similarity", F.lit("direct").alias("lane")).unionByName(found.select("query_id", "story_id", "score", F.round("score", 4).alias("similarity"), F.lit("graph").alias("lane")))
    first = F.row_number().over(Window.partitionBy("query_id", "story_id").orderBy(F.desc("score"), "lane"))
    one = both.withColumn("n", first).filter("n = 1").drop("n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "story_id"))).filter(F.col("rank") <= k)

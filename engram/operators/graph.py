"""Operators on the typed, weighted edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.params import DEFAULTS, Params
from engram.schemas import DIRECTED, EDGE_TYPES


def both_ways(edges: DataFrame) -> DataFrame:
    """Each active edge seen from both ends: node, neighbor, direction, and the edge's columns."""
    active = edges.filter(~F.col("deleted"))
    directed = F.col("edge_type").isin(*DIRECTED)
    ends = F.array(
        F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), F.when(directed, "outbound").otherwise("undirected").alias("direction")),
        F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("neighbor"), F.when(directed, "inbound").otherwise("undirected").alias("direction")),
    )
    return active.select("edge_id", "edge_type", "weight", F.explode(ends).alias("end")).select("end.*", "edge_id", "edge_type", "weight")


def can_traverse(edge_type: Column, direction: Column) -> Column:
    """Undirected edges any way, parent and child both ways, supersedes against its direction, others along it."""
    return F.when(direction == "undirected", True).when(edge_type == "parent_child", True).when(edge_type == "supersedes", direction == "inbound").otherwise(direction == "outbound")


def direction_factor(edge_type: Column, direction: Column) -> Column:
    return F.when((edge_type == "parent_child") & (direction == "inbound"), 0.9).otherwise(1.0)


def type_factor(edge_type: Column, params: Params = DEFAULTS) -> Column:
    out = F.lit(1.0)
    for name, factor in params.type_factor.items():
        out = F.when(edge_type == name, F.lit(factor)).otherwise(out)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over active edges, both ends counted."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, nodes: DataFrame, fan_out: int = DEFAULTS.fan_out) -> DataFrame:
    """The heaviest `fan_out` passable edges of every node: node, neighbor, edge_id, edge_type, direction, weight, place,
    suppressed (edges that policy hides) and truncated (more passable edges than shown).

    Policy comes before the limit, so that hidden edges take no places.
    """
    seen = both_ways(edges).join(nodes.select(F.col("story_id").alias("node")).distinct().hint("merge"), "node", "left_semi")
    seen = seen.withColumn("open", can_traverse(F.col("edge_type"), F.col("direction")))
    node = Window.partitionBy("node")
    seen = seen.withColumn("suppressed", F.sum((~F.col("open")).cast("int")).over(node)).withColumn("passable", F.sum(F.col("open").cast("int")).over(node))
    best = seen.filter("open").withColumn("place", F.row_number().over(node.orderBy(F.desc("weight"), "edge_id"))).filter(F.col("place") <= fan_out)
    return best.select("node", "neighbor", "edge_id", "edge_type", "direction", "weight", "place", "suppressed", (F.col("passable") > fan_out).alias("truncated"))


def related(hits: DataFrame, edges: DataFrame, stories: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest active neighbours of every hit, each by its strongest edge: story_id, neighbor, edge_id, weight, place."""
    seen = both_ways(edges).join(hits.select(F.col("story_id").alias("node")).distinct().hint("merge"), "node", "left_semi")
    seen = seen.join(stories.select(F.col("story_id").alias("neighbor")).hint("merge"), "neighbor", "left_semi")
    pair = seen.withColumn("n", F.row_number().over(Window.partitionBy("node", "neighbor").orderBy(F.desc("weight"), "edge_id"))).filter("n = 1")
    best = pair.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "edge_id"))).filter(F.col("place") <= k)
    return best.select(F.col("node").alias("story_id"), "neighbor", "edge_id", "edge_type", "direction", "weight", "place")


def superseded(edges: DataFrame, active: DataFrame) -> DataFrame:
    """story_id of every story that an active one supersedes."""
    return edges.filter((F.col("edge_type") == "supersedes") & ~F.col("deleted")).join(active.select(F.col("story_id").alias("source_id")).hint("merge"), "source_id", "left_semi").select(F.col("target_id").alias("story_id")).distinct()


def two_hop(seeds: DataFrame, edges: DataFrame, params: Params = DEFAULTS, hops: int = 2) -> DataFrame:
    """Best path score per (seed, node) within `hops` hops, without budgets: seed, node, score, hop."""
    steps = both_ways(edges).filter(can_traverse(F.col("edge_type"), F.col("direction")))
    steps = steps.select("node", "neighbor", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")) * type_factor(F.col("edge_type"), params) * direction_factor(F.col("edge_type"), F.col("direction"))).alias("step"))
    front = seeds.select(F.col("story_id").alias("seed"), F.col("story_id").alias("node"), F.lit(1.0).alias("product"))
    out = None
    for hop in range(1, hops + 1):
        front = front.join(steps.hint("merge"), "node").filter(F.col("neighbor") != F.col("seed")).select("seed", F.col("neighbor").alias("node"), (F.col("product") * F.col("step")).alias("product"))
        front = front.groupBy("seed", "node").agg(F.max("product").alias("product"))
        reached = front.select("seed", "node", F.round(F.col("product") * params.hop_decay ** (hop - 1), 12).alias("score"), F.lit(hop).alias("hop"))
        out = reached if out is None else out.unionByName(reached)
    best = Window.partitionBy("seed", "node").orderBy(F.desc("score"), "hop")
    return out.withColumn("n", F.row_number().over(best)).filter(F.col("n") == 1).drop("n").filter(F.col("score") >= params.least_score)


def canonical(edges: DataFrame) -> DataFrame:
    """Known types, ordered ends where undirected, weights within 0 and 1."""
    kind = F.when(F.col("edge_type").isin(*EDGE_TYPES), F.col("edge_type")).otherwise("semantic")
    flip = ~kind.isin(*DIRECTED) & (F.col("source_id") > F.col("target_id"))
    return edges.withColumns({
        "edge_type": kind, "source_id": F.when(flip, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(flip, F.col("source_id")).otherwise(F.col("target_id")),
        "weight": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")),
    })


def normalize(edges: DataFrame, stories: DataFrame) -> DataFrame:
    """Canonical edges; parent and child turned as the stories have them; one edge per key with its largest weight."""
    parents = stories.filter(F.col("parent_id").isNotNull()).select(F.col("story_id").alias("child"), "parent_id")
    turned = edges.join(parents.hint("shuffle_hash"), (F.col("edge_type") == "parent_child") & (F.col("source_id") == F.col("child")) & (F.col("target_id") == F.col("parent_id")), "left")
    turned = turned.withColumns({"source_id": F.when(F.col("child").isNotNull(), F.col("parent_id")).otherwise(F.col("source_id")), "target_id": F.when(F.col("child").isNotNull(), F.col("child")).otherwise(F.col("target_id"))}).drop("child", "parent_id")
    return canonical(turned).filter("source_id <> target_id").groupBy("source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"), F.min("deleted").alias("deleted"))


KEY = ("source_id", "target_id", "edge_type")


def merged_provenance(rows: DataFrame, order: str) -> DataFrame:
    """The edge key and provenance: the entries of all rows of an edge as one map, name by name; of the values of one name
    that with the largest `order` counts, of equal ones the larger value. Edges without entries have no row.

    A value is chosen by an aggregate that is combined before the shuffle, so that an edge gathers its distinct names only.
    """
    entries = rows.select(*KEY, F.col(order).alias("at"), F.explode("provenance").alias("name", "value"))
    last = entries.groupBy(*KEY, "name").agg(F.max(F.struct("at", "value")).alias("last"))
    return last.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("last.value").alias("value"))))).alias("provenance"))


def combine(rows: DataFrame, order: str) -> DataFrame:
    """One edge per key: the largest weight, deleted only if all are, all provenance (later rows win), and the largest
    version, one up where several rows have become one.

    rows: source_id, target_id, edge_type, weight, deleted, version, provenance and the column that orders them.
    """
    form = canonical(rows)
    one = form.groupBy(*KEY).agg(F.max("weight").alias("weight"), F.min("deleted").alias("deleted"), (F.max("version") + (F.count("*") > 1).cast("int")).alias("version"))
    return one.join(merged_provenance(form, order).hint("merge"), list(KEY), "left")


def _entries(provenance: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(provenance, F.expr("cast(map() as map<string,string>)"))))


def upsert(edges: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Merge edges into the table: largest weight, deleted ones revived; version goes up by one where anything changed.

    edges: source_id, target_id, edge_type, weight, deleted, version. incoming: source_id, target_id, edge_type, weight.
    With `order`, both have a map `provenance` too, whose entries are merged name by name: incoming ones win, among them
    those with the largest `order`. An edge that isn't deleted and gains neither weight nor entries keeps its version.
    """
    form = canonical(incoming).filter("source_id <> target_id")
    new = form.groupBy(*KEY).agg(F.max("weight").alias("new"))
    if order is not None:
        new = new.join(merged_provenance(form, order).withColumnRenamed("provenance", "added").hint("merge"), list(KEY), "left")
    both = edges.join(new.hint("merge"), list(KEY), "full_outer")
    weight = F.greatest("weight", "new")
    gained = F.col("weight").isNull() | F.col("deleted") | (F.col("new") > F.col("weight"))
    extra = []
    if order is not None:
        own = F.filter(_entries(F.col("provenance")), lambda e: ~F.coalesce(F.map_contains_key("added", e["key"]), F.lit(False)))
        merged = F.array_sort(F.concat(own, _entries(F.col("added"))))
        gained = gained | (merged != _entries(F.col("provenance")))
        extra = [F.map_from_entries(merged).alias("provenance")]
    changed = F.col("new").isNotNull() & gained
    return both.select(*KEY, weight.alias("weight"), F.when(F.col("new").isNotNull(), False).otherwise(F.col("deleted")).alias("deleted"), (F.coalesce("version", F.lit(0)) + changed.cast("int")).alias("version"), *extra)


def reinforce(edges: DataFrame, pairs: DataFrame, step: float = DEFAULTS.weight_step, most: float = DEFAULTS.weight_max) -> DataFrame:
    """Strengthen one edge per unordered pair (a, b): a semantic one first, then the heaviest, then the smallest id."""
    wanted = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    placed = edges.filter("not deleted").withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    first = Window.partitionBy("a", "b").orderBy((F.col("edge_type") != "semantic").cast("int"), F.desc("weight"), "edge_id")
    chosen = placed.join(wanted.hint("merge"), ["a", "b"]).withColumn("place", F.row_number().over(first)).filter("place = 1").select("edge_id", "n")
    return edges.join(chosen.hint("merge"), "edge_id", "left").withColumn("weight", F.when(F.col("n").isNotNull(), F.least(F.lit(most), F.col("weight") + step * F.col("n"))).otherwise(F.col("weight"))).drop("n")


def delete_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Soft-delete edges between the pairs (a, b, edge_type or null for all), whichever way they point."""
    listed = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("edge_type").alias("kind")).distinct()
    hit = edges.join(listed.hint("merge"), (F.least("source_id", "target_id") == F.col("lo")) & (F.greatest("source_id", "target_id") == F.col("hi")) & (F.col("kind").isNull() | (F.col("kind") == F.col("edge_type"))), "left_semi").select("edge_id").withColumn("hit", F.lit(True))
    return edges.join(hit.hint("merge"), "edge_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("hit", F.lit(False))).drop("hit")


def co_recall_pairs(lists: DataFrame, keys: list[str], item: str = "story_id", most: int | None = None) -> DataFrame:
    """a, b, n: how many lists hold both. Lists are short by contract; with `most`, longer ones are an error, not cut."""
    items = lists.select(*keys, item).distinct()
    grouped = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    if most is not None:
        grouped = grouped.withColumn("items", F.when(F.size("items") > most, F.raise_error(F.lit(f"a list of more than {most} items"))).otherwise(F.col("items")))
    head = grouped.select(F.posexplode("items").alias("i", "a"), "items")
    return head.select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def feedback(edges: DataFrame, lists: DataFrame, keys: list[str], active: DataFrame, step: float = DEFAULTS.weight_step) -> DataFrame:
    """Edges after recall lists: pairs in a list get a co_recall edge, and their other edges grow by a step per list."""
    used = lists.join(active.select("story_id").hint("merge"), "story_id", "left_semi")
    pairs = co_recall_pairs(used, keys)
    grown = edges.join(pairs.hint("merge"), (F.col("source_id") == F.col("a")) & (F.col("target_id") == F.col("b")) & ((F.col("edge_type") == "co_recall") | ~F.col("deleted")), "left")
    old = grown.select("source_id", "target_id", "edge_type", F.when(F.col("n").isNotNull(), F.least(F.lit(1.0), F.when(F.col("deleted"), 0.0).otherwise(F.col("weight")) + step * F.col("n"))).otherwise(F.col("weight")).alias("weight"), (F.col("deleted") & F.col("n").isNull()).alias("deleted"))
    new = pairs.join(edges.filter("edge_type = 'co_recall'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).hint("merge"), ["a", "b"], "left_anti")
    new = new.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("co_recall").alias("edge_type"), F.least(F.lit(1.0), step * F.col("n")).alias("weight"), F.lit(False).alias("deleted"))
    return old.unionByName(new)


def decay(edges: DataFrame, today: Column, half_life: float = DEFAULTS.co_recall_half_life_days, least: float = DEFAULTS.co_recall_least) -> DataFrame:
    """Half-life decay of co_recall edges since updated_day; those that fall below the floor are soft-deleted."""
    days = F.greatest(F.lit(0), F.datediff(today, "updated_day"))
    decays = (F.col("edge_type") == "co_recall") & ~F.col("deleted")
    weight = F.when(decays, F.col("weight") * F.pow(F.lit(0.5), days / half_life)).otherwise(F.col("weight"))
    return edges.withColumn("weight", weight).withColumn("deleted", F.col("deleted") | (decays & (F.col("weight") < least)))

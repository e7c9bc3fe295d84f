"""Consolidation: new stories against the store, and within their own batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.evaluation import branch
from engram.operators.vector import vector_pairs, vector_topk
from engram.params import DEFAULTS, Params
from engram.sources.stage_tables import materialize

#: Links that one task works off in order; more of them are thinned out round by round.
FEW_LINKS = 100_000


def candidates(new: DataFrame, stories: DataFrame, params: Params = DEFAULTS, near: bool = False) -> DataFrame:
    """query_id, story_id, similarity, rank, band (high, low or none) of the nearest stories of every new vector; with
    `near` only those of the bands high and low, which are all that decisions and edges stand on."""
    found = vector_topk(new, stories, params.top_retrieval, least=min(params.sim_low, params.sim_high) if near else None)
    return found.withColumn("band", F.when(F.col("similarity") >= params.sim_high, "high").when(F.col("similarity") >= params.sim_low, "low").otherwise("none"))


def decide(found: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """query_id, branch, target: what happens to each new story."""
    first = found.filter("rank = 1").withColumn("branch", branch(F.col("similarity"), params.sim_high, params.sim_update_only))
    return first.select("query_id", "branch", F.when(F.col("branch") != "create", F.col("story_id")).alias("target"), "similarity")


def create_edges(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Semantic edges of created stories to their weak matches, weighted by similarity."""
    created = decisions.filter("branch = 'create'").select("query_id")
    return found.filter("band = 'low'").join(created.hint("merge"), "query_id", "left_semi").select(F.least("query_id", "story_id").alias("source_id"), F.greatest("query_id", "story_id").alias("target_id"), F.lit("semantic").alias("edge_type"), F.col("similarity").alias("weight"))


def update_pairs(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs to reinforce after updates: the target with every other match."""
    updated = decisions.filter("branch <> 'create'").select("query_id", "target")
    return found.filter("band <> 'none'").join(updated.hint("merge"), "query_id").filter("story_id <> target").select(F.col("target").alias("a"), F.col("story_id").alias("b"))


def merge_lists(rows: DataFrame, key: str, lists: list[str], order: str) -> DataFrame:
    """Lists of one key joined in order, without repeats (the first place counts). Only what is distinct is gathered."""

    def joined(name: str) -> DataFrame:
        items = rows.select(key, order, F.posexplode_outer(name).alias("i", "v"))
        first = items.groupBy(key, "v").agg(F.min(F.struct(order, "i")).alias("first"))
        ordered = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("first", "v"))))
        return first.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias(name))

    return reduce(lambda a, b: a.join(b.withColumnRenamed(key, "other").hint("merge"), F.col(key).eqNullSafe(F.col("other"))).drop("other"), map(joined, lists))


#: Fields that a merge joins as texts, and by what; and those that are lists, in which the first place of an entry counts.
TEXTS = {"abstract": "；", "problem": "\n\n", "outcome": "\n\n"}
LISTS = ("actions", "evidence", "sources", "applies")


def fold_into_targets(decisions: DataFrame, new: DataFrame, stories: DataFrame) -> DataFrame:
    """One row per story that new ones are merged into or add to: story_id, the fields, keywords, session_ids and n_merged,
    n_updated, as if the new stories had come one after another in order of query_id.

    decisions: query_id, branch (others than merge and update are passed over), target. new: query_id, TEXTS, LISTS,
    keywords, session_id. stories: story_id, TEXTS, LISTS, keywords, session_ids. A merge brings all fields, an update only
    keywords and its session. Texts are joined where they aren't empty, lists keep the first place of an entry, keywords
    are sorted. What is gathered for a story is its own result; counts and lists are combined before they are shuffled.
    """
    taken = decisions.filter("branch in ('merge', 'update')").select("query_id", F.col("target").alias("story_id"), "branch")
    place = lambda first, i: F.struct(F.lit(first).alias("late"), i.alias("id")).alias("place")
    own = stories.join(taken.select("story_id").distinct().hint("merge"), "story_id", "left_semi")
    own = own.select("story_id", place(0, F.col("story_id")), *TEXTS, *LISTS, "keywords", "session_ids", F.lit("old").alias("branch"))
    merges = F.col("branch") == "merge"
    added = new.join(taken.hint("merge"), "query_id").select("story_id", place(1, F.col("query_id")), *(F.when(merges, F.col(c)).alias(c) for c in (*TEXTS, *LISTS)), "keywords", F.array("session_id").alias("session_ids"), "branch")
    rows = materialize(own.unionByName(added), "fold")
    said = {c: F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("place", F.col(c).alias("text"))))) for c in TEXTS}
    texts = rows.groupBy("story_id").agg(*(F.array_join(F.transform(said[c], lambda x: x["text"]), mark).alias(c) for c, mark in TEXTS.items()), F.count_if(merges).alias("n_merged"), F.count_if(F.col("branch") == "update").alias("n_updated"))
    lists = merge_lists(rows, "story_id", [*LISTS, "keywords", "session_ids"], "place")
    return texts.join(lists.hint("merge"), "story_id").withColumn("keywords", F.array_sort("keywords"))


def numbered_events(turns: DataFrame, versions: DataFrame) -> DataFrame:
    """entity_id, operation, base_version, version, session_id of what happened to each entity, in order of session_id.

    turns: entity_id, operation, session_id; a create comes first and makes version 1. versions: entity_id and its version
    before the turns, or 1 where one of them creates it. An entity's turns are numbered by a window, which spills.
    """
    order = Window.partitionBy("entity_id").orderBy(F.col("operation") != "create", "session_id")
    created = F.max(F.col("operation") == "create").over(Window.partitionBy("entity_id"))
    placed = turns.withColumns({"n": F.row_number().over(order), "created": created}).join(versions.hint("merge"), "entity_id")
    at = F.when(F.col("created"), F.col("n")).otherwise(F.col("version") + F.col("n")).cast("long")
    return placed.select("entity_id", "operation", (at - 1).alias("base_version"), at.alias("version"), "session_id")


def split_story(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of stories that are split, and their edges: parent to child at 1.0, siblings among themselves at 0.5.

    parents: story_id, parts (array of texts). A child is known by its parent and place.
    """
    child = parents.select("story_id", F.posexplode("parts").alias("place", "content"))
    kids = child.select(F.concat_ws("-", "story_id", "place").alias("child_id"), "story_id", "place", "content")
    down = kids.select(F.col("story_id").cast("string").alias("source_id"), F.col("child_id").alias("target_id"), F.lit("parent_child").alias("edge_type"), F.lit(1.0).alias("weight"))
    side = kids.alias("a").join(kids.alias("b").hint("merge"), (F.col("a.story_id") == F.col("b.story_id")) & (F.col("a.place") < F.col("b.place"))).select(F.col("a.child_id").alias("source_id"), F.col("b.child_id").alias("target_id"), F.lit("semantic").alias("edge_type"), F.lit(0.5).alias("weight"))
    return kids, down.unionByName(side)


def fold_status(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, status: failed if any story of a session failed, processed if it has results, else pending."""
    done = results.groupBy("conv_id").agg(F.max(F.col("failed").cast("int")).alias("failed"))
    return sessions.select("conv_id").join(done.hint("merge"), "conv_id", "left").select("conv_id", F.when(F.col("failed") == 1, "failed").when(F.col("failed") == 0, "processed").otherwise("pending").alias("status"))


def inference_memo(inputs: DataFrame, memo: DataFrame, text: str) -> DataFrame:
    """input_hash, uses, cached: distinct inputs of a model, how often each is asked for, and whether its answer is known."""
    hashed = inputs.select(F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("input_hash")).groupBy("input_hash").agg(F.count("*").alias("uses"))
    return hashed.join(memo.select("input_hash", F.lit(True).alias("known")).hint("merge"), "input_hash", "left").select("input_hash", "uses", F.coalesce("known", F.lit(False)).alias("cached"))


def leaders(links: DataFrame, members: DataFrame) -> DataFrame:
    """story_id, leader: each new story joins the earliest story of its batch that is a leader and near enough; one that
    finds none leads itself. This is the order in which sessions are worked off one after another.

    links: a, b (a < b) of near pairs; members: story_id. A round settles every story without an earlier neighbour that is
    open, and its neighbours; only links between open stories go on to the next one, and one task follows the last few.
    """
    edges = materialize(links.select("a", "b").distinct(), "leader-links")
    open_, led = edges, members.sparkSession.createDataFrame([], "b long")
    while (n := open_.count()) > FEW_LINKS:
        heads = materialize(open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti"), "leader-heads")
        found = materialize(open_.join(heads.hint("merge"), "a", "left_semi").select("b").distinct(), "led")
        rest = open_.join(heads.hint("merge"), "a", "left_anti").join(found.hint("merge"), "b", "left_anti")
        open_ = materialize(rest.join(found.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti").select("a", "b"), "open-links")
        led = led.unionByName(found)
    if n:
        led = led.unionByName(open_.coalesce(1).mapInArrow(_led, "b long"))
    led = materialize(led, "led")
    first = edges.join(led.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("leader"))
    own = led.join(first.hint("merge"), "b").select(F.col("b").alias("story_id"), "leader")
    return members.select("story_id").join(own.hint("merge"), "story_id", "left").select("story_id", F.coalesce("leader", "story_id").alias("leader"))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stories that don't lead, of FEW_LINKS links at most."""
    parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((a, b))
    led: dict[int, bool] = {}
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if x not in led:
            led[y] = True
    yield pa.record_batch({"b": pa.array(list(led), pa.int64())})


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): new stories whose unit vectors have a cosine of `least` or more; blocks of the batch against the batch."""
    pairs = vector_pairs(rows.select("query_id", "vector"), rows.select(F.col("query_id").alias("story_id"), F.col("vector").alias("embedding")), least, later=True)
    return pairs.select(F.col("query_id").alias("a"), F.col("story_id").alias("b"))


def equal_vectors(rows: DataFrame) -> DataFrame:
    """query_id and first, the smallest query_id with the same vector; rows without a vector stand for themselves."""
    held = rows.filter("vector is not null").select("query_id", "vector")
    firsts = materialize(held.groupBy("vector").agg(F.min("query_id").alias("first")), "distinct-vectors")
    found = held.join(firsts.hint("merge"), "vector").select("query_id", "first")
    return found.unionByName(rows.filter("vector is null").select("query_id", F.col("query_id").alias("first")))


def batch_consolidation(new: DataFrame, stories: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """query_id, branch, target for a batch: against the store first, then among those that matched nothing.

    new: query_id, vector. Vectors that merges would move within the batch are not moved.
    """
    return consolidated(new, candidates(new, stories, params), params)


def consolidated(new: DataFrame, found: DataFrame, params: Params = DEFAULTS, copies: DataFrame | None = None) -> DataFrame:
    """The same with the nearest stories of the store found beforehand; new stories that found none are compared too.

    copies: equal_vectors of new, if known. What is near one of them is near all, so that the first stands for the others:
    they follow whom it follows, or itself if it leads.
    """
    decided = materialize(decide(found, params), "decisions")
    fresh = new.join(decided.filter("branch <> 'create'").select("query_id").hint("merge"), "query_id", "left_anti")
    fresh = materialize(fresh.select("query_id", "vector"), "unmatched")
    copies = materialize(equal_vectors(fresh) if copies is None else copies.join(fresh.select("query_id").hint("merge"), "query_id", "left_semi"), "unmatched-copies")
    firsts = materialize(fresh.join(copies.filter("query_id = first").select("query_id").hint("merge"), "query_id", "left_semi").sort("query_id"), "unmatched-firsts")
    led = leaders(near_pairs(firsts, params.sim_high), firsts.select(F.col("query_id").alias("story_id")))
    led = copies.join(led.withColumnRenamed("story_id", "first").hint("merge"), "first").select("query_id", "leader")
    matched = decided.filter("branch <> 'create'").select("query_id", "branch", "target")
    return matched.unionByName(led.select("query_id", F.when(F.col("leader") == F.col("query_id"), "create").otherwise("merge").alias("branch"), F.when(F.col("leader") != F.col("query_id"), F.col("leader")).alias("target")))

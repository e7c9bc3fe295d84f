"""Lifecycle, audits and reports on stories, sessions and edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.params import DEFAULTS, Params
from engram.sources.stage_tables import materialize


def access_decay(stories: DataFrame, today: Column, half_life: float = 30.0) -> DataFrame:
    """story_id, access_score (halved every half_life days since last_day), access_count (rounded half to even), changed."""
    days = F.greatest(F.lit(0), F.datediff(today, "last_day"))
    score = F.col("access_count") * F.pow(F.lit(0.5), days / half_life)
    return stories.select("story_id", score.alias("access_score"), F.bround(score).cast("long").alias("new_count"), (F.bround(score).cast("long") != F.col("access_count")).alias("changed"))


def heaviest_edge(stories: DataFrame, edges: DataFrame) -> DataFrame:
    """story_id, weight: the largest active edge weight of every story, zero for one without edges."""
    ends = edges.filter("not deleted").select(F.explode(F.array("source_id", "target_id")).alias("story_id"), "weight")
    return stories.select("story_id").join(ends.groupBy("story_id").agg(F.max("weight").alias("weight")).hint("merge"), "story_id", "left").fillna(0.0, ["weight"])


def archive_candidates(stories: DataFrame, edges: DataFrame, today: Column, params: Params = DEFAULTS) -> DataFrame:
    """Active stories that are unused, old, loosely tied and have no active child."""
    active = stories.filter("not deleted and not archived")
    old = active.filter((F.col("access_count") <= 0) & (F.datediff(today, "last_day") >= params.archive_days))
    parents = active.filter("parent_id is not null").select(F.col("parent_id").alias("story_id"))
    loose = heaviest_edge(old, edges).filter(F.col("weight") <= params.archive_weight)
    return loose.join(parents.hint("merge"), "story_id", "left_anti")


def archive(stories: DataFrame, edges: DataFrame, today: Column, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply the archive: stories marked, their edges soft-deleted, and the ids whose vectors go."""
    gone = archive_candidates(stories, edges, today, params).select("story_id", F.lit(True).alias("gone"))
    marked = stories.join(gone.hint("merge"), "story_id", "left").withColumn("archived", F.col("archived") | F.coalesce("gone", F.lit(False))).drop("gone")
    ends = edges.join(gone.select(F.col("story_id").alias("source_id"), F.col("gone").alias("g1")).hint("merge"), "source_id", "left").join(gone.select(F.col("story_id").alias("target_id"), F.col("gone").alias("g2")).hint("merge"), "target_id", "left")
    return marked, ends.withColumn("deleted", F.col("deleted") | F.coalesce("g1", "g2", F.lit(False))).drop("g1", "g2"), gone.select("story_id")


def tombstones(stories: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete stories for good: vector gone, status archived, version one up; those already deleted stay as they are."""
    hit = stories.join(ids.select("story_id", F.lit(True).alias("hit")).distinct().hint("merge"), "story_id", "left")
    now = F.coalesce("hit", F.lit(False)) & ~F.col("deleted")
    return hit.withColumns({"no_vector": F.col("no_vector") | now, "embedding_status": F.when(now, "archived").otherwise(F.col("embedding_status")), "version": F.col("version") + now.cast("int"), "deleted": F.col("deleted") | now}).drop("hit")


def story_stats(stories: DataFrame, sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, n: counts of the store, one pass per table."""
    active = ~F.col("deleted") & ~F.col("archived")
    s = stories.agg(F.count_if(active).alias("active_stories"), F.count_if(F.col("archived")).alias("archived_stories"), F.count_if(active & F.col("parent_id").isNull()).alias("root_stories"), F.count_if(active & F.col("parent_id").isNotNull()).alias("child_stories"), F.count_if(F.col("deleted")).alias("tombstones"))
    t = sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("status") == "pending").alias("pending_sessions"), F.count_if(F.col("status") == "processed").alias("processed_sessions"))
    e = edges.agg(F.count_if(~F.col("deleted")).alias("active_edges"))
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("metric", "n"))
    return long(s).unionByName(long(t)).unionByName(long(e))


def vector_consistency(stories: DataFrame, vectors: DataFrame) -> DataFrame:
    """story_id, problem: active stories without a vector, and vectors without an active story."""
    active = stories.filter("not deleted and not archived and not no_vector").select("story_id")
    ids = vectors.select("story_id").distinct()
    return active.join(ids, "story_id", "left_anti").withColumn("problem", F.lit("missing_vec")).unionByName(ids.join(active, "story_id", "left_anti").withColumn("problem", F.lit("orphan_vec")))


def backfill_pending(stories: DataFrame, shadow: DataFrame, identity: dict[str, object]) -> DataFrame:
    """Active stories without a ready shadow row of the same content hash and target identity. stories: story_id, content_hash, active."""
    ready = shadow.filter("status = 'ready'")
    for name, value in identity.items():
        ready = ready.filter(F.col(name).eqNullSafe(F.lit(value)))
    return stories.filter("active").join(ready.select("story_id", "content_hash"), ["story_id", "content_hash"], "left_anti").select("story_id", "content_hash")


def backfill_gate(stories: DataFrame, shadow: DataFrame) -> DataFrame:
    """One row: n_active, n_ready, n_failed, n_dimensions, complete (all ready in one dimension)."""
    both = stories.filter("active").join(shadow.select("story_id", F.col("content_hash").alias("s_hash"), "status", "dimension"), "story_id", "left")
    ready = F.coalesce((F.col("status") == "ready") & (F.col("s_hash") == F.col("content_hash")), F.lit(False))
    return both.agg(F.count("*").alias("n_active"), F.count_if(ready).alias("n_ready"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_distinct(F.when(ready, F.col("dimension"))).alias("n_dimensions")).withColumn("complete", (F.col("n_active") == F.col("n_ready")) & (F.col("n_dimensions") == 1))


def referential_audit(stories: DataFrame, edges: DataFrame, session_refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """kind, id: parents, sessions and edge ends that don't exist. session_refs: story_id, session_id."""
    ids = stories.select("story_id")
    parent = stories.filter("parent_id is not null").join(ids.select(F.col("story_id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("parent").alias("kind"), F.col("story_id").alias("id"))
    session = session_refs.join(sessions.select("session_id"), "session_id", "left_anti").select(F.lit("session").alias("kind"), F.col("story_id").alias("id"))
    ends = edges.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("story_id"))
    edge = ends.join(ids.hint("merge"), "story_id", "left_anti").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).distinct()
    return parent.unionByName(session).unionByName(edge)


def generation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one generation only, with `side`; repeated rows count."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def fingerprint(df: DataFrame, by: Sequence[Column] = (), parts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """n and a hash of the rows of a table, whatever their order, or of each of its groups; with `parts`, a hash for each
    named set of columns instead. Two hashes of 64 bits are summed, so that what differs doesn't meet by chance."""
    parts = {"hash": df.columns} if parts is None else parts
    said = lambda columns: [x for c in columns for x in (F.col(c).isNull(), F.col(c))]  # noqa: E731  (a hash passes over nulls)
    summed = lambda columns: F.struct(*(F.sum(F.xxhash64(F.lit(i), *said(columns)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(summed(columns).alias(name) for name, columns in parts.items()))


def reconcile(old: DataFrame, new: DataFrame, key: str, parts: Mapping[str, Sequence[str]], buckets: int = 4096) -> DataFrame:
    """key, state (missing, added, changed) and parts (names of those that differ) of the rows by which two generations of
    a table differ.

    Both are digested by bucket of keys first, which shuffles a row per task and bucket; only rows of buckets that differ,
    a list of `buckets` at most that is sent to every task, are looked at one by one. Rows that repeat a key are compared
    as a bag, and differ in their number as in a part of its own, `rows`.
    """
    named = {name: [key, *columns] for name, columns in parts.items()}
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    side = lambda df, name, by: fingerprint(df, by, named).select("bucket" if by[0] is bucket else key, F.struct("n", *parts).alias(name))
    different = side(old, "old", [bucket]).join(side(new, "new", [bucket]).hint("merge"), "bucket", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    different = materialize(different.select(F.col("bucket").alias("different")), "buckets")
    left = lambda df: df.join(F.broadcast(different), bucket == F.col("different"), "left_semi")
    o, n = side(left(old), "old", [F.col(key)]).withColumnRenamed(key, "o_key"), side(left(new), "new", [F.col(key)]).withColumnRenamed(key, "n_key")
    both = o.join(n.hint("merge"), F.col("o_key").eqNullSafe(F.col("n_key")), "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").otherwise("changed")
    differs = [F.when(F.col("old.n") != F.col("new.n"), "rows"), *(F.when(~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}")), name) for name in parts)]
    listed = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.array_compact(F.array(*differs))).otherwise(F.expr("cast(array() as array<string>)"))
    return both.select(F.coalesce("o_key", "n_key").alias(key), state.alias("state"), listed.alias("parts"))


def session_upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, action (created, updated, unchanged, absent) and the fields as they are afterwards; a change makes a session pending."""
    old = existing.select(key, F.struct(*fields).alias("old"))
    both = old.join(incoming.select(key, F.struct(*fields).alias("new")), key, "full_outer")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "absent").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    kept = F.coalesce("new", "old")
    return both.select(key, action.alias("action"), *(kept[f].alias(f) for f in fields), F.when(action.isin("created", "updated"), "pending").otherwise("processed").alias("status"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, state of every file of a listing against the last one: new, appended, rewritten, unchanged, degraded (gone), reparse."""
    o = old.select("url", *(F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "digest", "adapter")))
    both = o.join(new, "url", "full_outer")
    state = (
        F.when(F.col("o_size").isNull(), "new").when(F.col("size").isNull(), "degraded").when(F.col("adapter") != F.col("o_adapter"), "reparse")
        .when((F.col("digest") == F.col("o_digest")) & (F.col("size") == F.col("o_size")) & (F.col("mtime") == F.col("o_mtime")), "unchanged")
        .when(F.col("size") > F.col("o_size"), "appended").otherwise("rewritten")
    )
    return both.select("url", state.alias("state"))


def dimension_rollup(rows: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """The latest value that is not null, per key and attribute."""
    return rows.groupBy(key).agg(*(F.max_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.struct(at, F.col(a)))).alias(a) for a in attributes))


def repair_plan(stories: DataFrame, vectors: DataFrame) -> DataFrame:
    """story_id, action: vectors to rebuild and to clear."""
    return vector_consistency(stories, vectors).select("story_id", F.when(F.col("problem") == "missing_vec", "rebuild").otherwise("clear").alias("action"))


def revision_gaps(revisions: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Revisions whose version doesn't follow the one before."""
    before = F.lag("version").over(Window.partitionBy(entity).orderBy("version"))
    return revisions.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("version") != F.col("before") + 1))


def schema_check(events: DataFrame, operations: Sequence[str]) -> DataFrame:
    """sequence, reason: rows that break the contract of the event log."""
    tests = {"no_entity": F.col("entity_id").isNull(), "bad_operation": F.col("operation").isNull() | ~F.col("operation").isin(*operations), "bad_version": F.coalesce(F.col("version") <= F.col("base_version"), F.lit(True)), "negative_base": F.coalesce(F.col("base_version") < 0, F.lit(False))}
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return events.select("sequence", F.explode(reasons).alias("reason"))

"""The full cycle: pending sessions become stories, edges, events and a status, all at once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import consolidate, graph
from engram.operators.representations import with_hashed_vectors
from engram.params import DEFAULTS, Params
from engram.sources import snapshots
from engram.sources.stage_tables import materialize

JOB = "cycle"
STORIES = (
    "story_id long, title string, abstract string, problem string, outcome string, actions array<string>, evidence array<string>, sources array<string>, "
    "applies array<string>, keywords array<string>, session_ids array<long>, embedding array<double>, version long"
)
EDGES = "source_id long, target_id long, edge_type string, weight double, deleted boolean, version long, provenance map<string,string>"
EVENTS = "entity_id long, operation string, base_version long, version long, session_id long"
SESSIONS = "session_id long, status string"


def _table(spark: SparkSession, root: str, name: str, schema: str, at: snapshots.State) -> DataFrame:
    found = snapshots.table(spark, root, name, at)
    return spark.createDataFrame([], schema) if found is None else found


def drafts(sessions: DataFrame) -> DataFrame:
    """A story of every session that says anything (session_id, problem_desc, conclusion): the fields of STORIES by
    query_id, with the vector of title and outcome; null where there are no terms."""
    asked, answered = F.trim(F.coalesce("problem_desc", F.lit(""))), F.trim(F.coalesce("conclusion", F.lit("")))
    rows = sessions.filter((asked != "") | (answered != "")).groupBy("session_id").agg(F.max(F.struct(asked.alias("asked"), answered.alias("answered"))).alias("s"))
    none = F.expr("cast(array() as array<string>)")
    fields = rows.select(
        F.col("session_id").alias("query_id"), "session_id", F.substring("s.asked", 1, 60).alias("title"), T.cut(F.concat_ws("；", F.nullif("s.asked", F.lit("")), F.nullif("s.answered", F.lit(""))), DEFAULTS.abstract_chars).alias("abstract"),
        F.col("s.asked").alias("problem"), F.col("s.answered").alias("outcome"), none.alias("actions"), none.alias("evidence"), F.array(F.concat(F.lit("session:"), "session_id")).alias("sources"), none.alias("applies"),
        F.slice(T.lexical_terms(F.col("s.asked")), 1, 5).alias("keywords"),
    )
    return with_hashed_vectors(fields, F.concat_ws("\n", "problem", "outcome"))


def consolidated(sessions: DataFrame, root: str, before: snapshots.State, params: Params = DEFAULTS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables and additions to logs that a batch of sessions makes of one state of a store.

    A session that is near a story of the store, or a session before it in its batch, is merged into it or adds to it; any
    other becomes a story, with edges to those that are somewhat near. Targets are tied more strongly to what else was
    near. Every change of a story is an event, in order of sessions. A session without text is done without a story.
    """
    spark = sessions.sparkSession
    stories, edges, known = (_table(spark, root, name, schema, before) for name, schema in (("stories", STORIES), ("edges", EDGES), ("sessions", SESSIONS)))
    done = known.filter("status = 'processed'").select("session_id")
    pending = sessions.join(done.hint("merge"), "session_id", "left_anti")
    new = materialize(drafts(pending), "drafts")

    with_vector = new.filter("vector is not null").select("query_id", "vector")
    copies = materialize(consolidate.equal_vectors(with_vector), "copies")
    firsts = with_vector.join(copies.filter("query_id = first").select("query_id").hint("merge"), "query_id", "left_semi")
    near = materialize(consolidate.candidates(firsts, stories, params, near=True).withColumnRenamed("query_id", "first"), "near-firsts")
    found = materialize(copies.join(near.hint("merge"), "first").drop("first"), "found")
    decided = consolidate.consolidated(with_vector, found, params, copies)
    mute = new.filter("vector is null").select("query_id", F.lit("create").alias("branch"), F.lit(None).cast("long").alias("target"))
    decided = materialize(decided.select("query_id", "branch", "target").unionByName(mute), "decided")

    own = decided.filter("branch = 'create'").select("query_id")
    created = new.join(own.hint("merge"), "query_id", "left_semi").select(F.col("query_id").alias("story_id"), "title", *consolidate.TEXTS, *consolidate.LISTS, "keywords", F.array("session_id").alias("session_ids"), F.col("vector").alias("embedding"), F.lit(1).cast("long").alias("version"))
    base = materialize(stories.unionByName(created), "base")
    folded = consolidate.fold_into_targets(decided, new, base)
    changed = folded.select("story_id", F.struct(*(c for c in folded.columns if c != "story_id")).alias("f"))
    both = base.join(changed.hint("merge"), "story_id", "left")
    field = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c)
    grown = (F.coalesce("f.n_merged", F.lit(0)) + F.coalesce("f.n_updated", F.lit(0))).cast("long")
    after = both.select("story_id", "title", T.cut(field("abstract"), params.abstract_chars).alias("abstract"), field("problem"), field("outcome"), *map(field, consolidate.LISTS), field("keywords"), field("session_ids"), "embedding", (F.col("version") + grown).alias("version"))

    ties = consolidate.create_edges(found, decided).withColumn("provenance", F.create_map(F.lit("by"), F.lit(JOB)))
    pairs = consolidate.update_pairs(found, decided)
    linked = graph.upsert(edges, ties.withColumn("place", F.lit(before.number + 1)), "place")
    keyed = linked.withColumn("edge_id", F.concat_ws("-", "source_id", "target_id", "edge_type"))
    tied = graph.reinforce(keyed, pairs).drop("edge_id")

    turn = decided.select(F.coalesce("target", "query_id").alias("entity_id"), F.col("branch").alias("operation"), F.col("query_id").alias("session_id"))
    events = consolidate.numbered_events(turn, base.select(F.col("story_id").alias("entity_id"), "version"))
    status = known.join(pending.select("session_id").distinct().hint("merge"), "session_id", "left_anti").unionByName(pending.select("session_id").distinct().withColumn("status", F.lit("processed")))
    return {"stories": after, "edges": tied.select(*edges.columns), "sessions": status}, {"events": events}


def run(sessions: DataFrame, root: str, checkpoint: str, params: Params = DEFAULTS):
    """The cycle as a stream over all sessions that have arrived (session_id, problem_desc, conclusion); start it whenever
    a cycle is due. Each batch moves stories, edges, sessions and events of the store to one common state; a batch that was
    stopped anywhere is made again from the state before it, and one that was finished isn't made twice."""
    spark = sessions.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = snapshots.state(spark, root)
        if before.batches.get(JOB, -1) >= number:
            return
        tables, logs = consolidated(batch, root, before, params)
        snapshots.commit(spark, root, tables, logs, job=JOB, batch=number, before=before)

    return sessions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply)

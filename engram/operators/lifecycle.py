"""Revisions, provenance and re-embedding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import governance
from engram.sources import snapshots
from engram.sources.stage_tables import materialize


def revisions(stories: DataFrame, fields: Sequence[str]) -> DataFrame:
    """story_id, version, snapshot (JSON with the fields in order of name) and its sha256."""
    snapshot = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return stories.select("story_id", "version", snapshot.alias("snapshot")).withColumn("snapshot_hash", F.sha2(F.encode("snapshot", "UTF-8"), 256))


def baseline_events(entities: DataFrame, events: DataFrame) -> DataFrame:
    """A first event for every entity that has none: entity_id, base_version 0, version 1, operation create."""
    return entities.select("entity_id").distinct().join(events.select("entity_id").hint("merge"), "entity_id", "left_anti").select("entity_id", F.lit(0).cast("long").alias("base_version"), F.lit(1).cast("long").alias("version"), F.lit("create").alias("operation"))


def provenance(events: DataFrame, stories: DataFrame, sessions: DataFrame) -> DataFrame:
    """sequence, parent_id and the global ids of the sessions an event's story came from, in order.

    stories: entity_id, parent_id, session_ids. sessions: session_id, global_id.
    """
    known = events.join(stories.hint("merge"), "entity_id", "left")
    ids = known.select("sequence", F.explode("session_ids").alias("session_id")).join(sessions.hint("merge"), "session_id").groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "global_id"))), lambda s: s["global_id"]).alias("sessions"))
    return known.select("sequence", "parent_id").join(ids.hint("merge"), "sequence", "left").select("sequence", "parent_id", F.coalesce("sessions", F.expr("cast(array() as array<string>)")).alias("sessions"))


def merge_environments(rows: DataFrame, key: str, session: str, at: str, fields: Sequence[str]) -> DataFrame:
    """Environments of a key, one per session (the latest), in order of time."""
    one = rows.groupBy(key, session).agg(F.max(F.struct(at, *fields)).alias("e"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(f"e.{at}").alias(at), F.col(session), *(F.col(f"e.{f}").alias(f) for f in fields)))).alias("environments"))


def hashing_vector(terms: Column, dimension: int) -> Column:
    """A deterministic vector of length 1 from terms: each term adds or takes one at the place its hash names. Where all
    cancel, each adds one, so that only a text without terms has no vector (null)."""
    place = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimension)).alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    sums = lambda p, step: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(p, lambda x: x["at"] == i), F.lit(0.0), lambda s, x: s + step(x)))
    counts = lambda p: vectors.once(sums(p, lambda x: x["sign"]), lambda v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(sums(p, lambda x: F.lit(1.0))))
    return vectors.l2_normalize(vectors.once(place, counts))


def reembed(pending: DataFrame, vectorise: Callable[[Column], Column], dimension: int) -> DataFrame:
    """story_id, content_hash, embedding, status of pending rows (story_id, content_hash, text): failed where the vector is
    null, of another dimension, or zero. vectorise takes and returns a column: an expression or a pandas UDF."""
    made = pending.withColumn("embedding", vectorise(F.col("text")))
    good = F.coalesce((F.size("embedding") == dimension) & (vectors.l2_norm(F.col("embedding")) > 0), F.lit(False))
    return made.select("story_id", "content_hash", F.when(good, F.col("embedding")).alias("embedding"), F.when(good, "ready").otherwise("failed").alias("status"))


#: The log of attempts to embed: one row per attempt.
ATTEMPTS = "story_id long, identity string, content_hash string, status string, embedding array<double>"


def attempts_ledger(attempts: DataFrame, identity: str) -> DataFrame:
    """story_id, content_hash, attempts, status (ready if any attempt was) and embedding under one identity."""
    own = attempts.filter(F.col("identity") == identity)
    ready = F.col("status") == "ready"
    return own.groupBy("story_id", "content_hash").agg(F.count("*").alias("attempts"), F.max(F.when(ready, "ready").otherwise("failed")).alias("status"), F.max_by("embedding", F.when(ready, F.col("state"))).alias("embedding"))


def left_to_embed(stories: DataFrame, ledger: DataFrame, most_attempts: int) -> DataFrame:
    """story_id, content_hash, text of active stories that aren't ready as they are now and may be tried once more.

    stories: story_id, content_hash, text, active. A story whose text has changed starts with no attempts.
    """
    done = ledger.filter((F.col("status") == "ready") | (F.col("attempts") >= most_attempts)).select("story_id", "content_hash")
    return stories.filter("active").join(done.hint("merge"), ["story_id", "content_hash"], "left_anti").select("story_id", "content_hash", "text")


def reembed_in_slices(stories: DataFrame, root: str, identity: str, vectorise: Callable[[Column], Column], dimension: int, slices: int = 16, most_attempts: int = 3) -> int:
    """Embed what is left to embed, slice by slice; every slice is committed to the log of attempts of a store on its own.

    What was committed before an interruption isn't done again: what is left is asked for anew when the job starts, and
    attempts are counted over all runs. Returns the number of slices that had work.
    """
    spark = stories.sparkSession
    ledger = attempts_ledger(snapshots.log(spark, root, "attempts", ATTEMPTS), identity)
    left = materialize(left_to_embed(stories, ledger, most_attempts).withColumn("slice", F.pmod(F.xxhash64("story_id"), F.lit(slices)).cast("int")), "left-to-embed")
    busy = sorted(r["slice"] for r in left.select("slice").distinct().collect())
    for i in busy:
        made = reembed(left.filter(F.col("slice") == i), vectorise, dimension)
        rows = made.select("story_id", F.lit(identity).alias("identity"), "content_hash", "status", F.col("embedding").cast("array<double>").alias("embedding"))
        snapshots.commit(spark, root, {}, {"attempts": rows})
    return len(busy)


def activate_embeddings(stories: DataFrame, root: str, identity: str, dimension: int) -> bool:
    """Serve the vectors of an identity once every active story has one: vectors and the identity they are of become
    current together, or neither does. stories: story_id, content_hash, active."""
    spark = stories.sparkSession
    ledger = attempts_ledger(snapshots.log(spark, root, "attempts", ATTEMPTS), identity).withColumn("dimension", F.size("embedding"))
    ledger = ledger.join(stories.select("story_id", "content_hash").hint("merge"), ["story_id", "content_hash"], "left_semi")
    gate = governance.backfill_gate(stories, ledger).first()
    complete = gate["complete"] and gate["n_active"] > 0
    if not complete:
        return False
    ready = stories.filter("active").select("story_id", "content_hash").join(ledger.filter("status = 'ready'").hint("merge"), ["story_id", "content_hash"])
    vectors_at = snapshots.stage(spark, root, "vectors", ready.select("story_id", "content_hash", "embedding"))
    identity_at = snapshots.stage(spark, root, "identity", spark.createDataFrame([(identity, dimension)], "identity string, dimension int"))
    snapshots.activate(spark, root, {"vectors": vectors_at, "identity": identity_at}, complete)
    return True


def identity_mismatch(rows: DataFrame, model: str, dimension: int) -> DataFrame:
    """story_id, reasons: rows whose serving identity isn't that of the index."""
    tests = {"model": F.col("model") != model, "dimension": F.col("dimension") != dimension, "status": F.col("status") != "ready"}
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return rows.select("story_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def best_of_fields(similarities: DataFrame) -> DataFrame:
    """query_id, story_id, similarity: the best of a story's fields."""
    return similarities.groupBy("query_id", "story_id").agg(F.max("similarity").alias("similarity"))


def expand_queries(queries: DataFrame) -> DataFrame:
    """query_id, variant, text: each query as asked, with its rarer marks masked, and cut to its first word."""
    variants = F.array(
        F.struct(F.lit("exact").alias("variant"), F.col("text").alias("text")),
        F.struct(F.lit("cross_tool").alias("variant"), F.regexp_replace("text", "[A-Za-z0-9_]{9,}", "it").alias("text")),
        F.struct(F.lit("ambiguous").alias("variant"), F.split("text", " ")[0].alias("text")),
    )
    return queries.select("query_id", F.explode(variants).alias("v")).select("query_id", "v.*")


def attach_transforms(queries: DataFrame, made: DataFrame) -> DataFrame:
    """query_id, output (null: missed): transforms made beforehand, found by the hash of the query."""
    return queries.withColumn("query_sha256", F.sha2(F.encode("text", "UTF-8"), 256)).join(made.dropDuplicates(["query_sha256"]), "query_sha256", "left").select("query_id", "output")

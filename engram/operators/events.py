"""Replay of an append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tombstones(events: DataFrame) -> DataFrame:
    """entity_id, version, sequence of the delete with the highest version, for every entity that has one."""
    deletes = events.filter("operation = 'delete'")
    return deletes.groupBy("entity_id").agg(F.max(F.struct("version", "sequence")).alias("m")).select("entity_id", "m.version", "m.sequence")


def ignored(events: DataFrame) -> DataFrame:
    """Events of entities that are ever deleted, other than the deletes."""
    return events.filter("operation <> 'delete'").join(tombstones(events).select("entity_id").hint("merge"), "entity_id", "left_semi")


def folded(events: DataFrame) -> DataFrame:
    """entity_id, version, accepted, conflicts (array of sequence, expected, actual) of entities that are never deleted.

    In order of sequence, time and id an event is accepted if its base version is the entity's version, and otherwise a
    conflict that leaves the entity as it is. The chain needs one entity's events together: they are gathered as numbers
    only, in one row of one task, so that an entity's history must fit there.
    """
    live = events.join(tombstones(events).select("entity_id").hint("merge"), "entity_id", "left_anti")
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("sequence", F.lit(0)).alias("sequence"), "created_at", "base_version", "version")))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("accepted"), F.expr("cast(array() as array<struct<sequence:bigint,expected:bigint,actual:bigint>>)").alias("conflicts"))

    def step(s, e):
        fits = e["base_version"] == s["version"]
        clash = F.array(F.struct(e["sequence"].cast("long").alias("sequence"), s["version"].alias("expected"), e["base_version"].cast("long").alias("actual")))
        return F.struct(F.when(fits, e["version"].cast("long")).otherwise(s["version"]).alias("version"), (s["accepted"] + fits.cast("long")).alias("accepted"), F.when(fits, s["conflicts"]).otherwise(F.concat(s["conflicts"], clash)).alias("conflicts"))

    return live.groupBy("entity_id").agg(F.aggregate(items, start, step).alias("s")).select("entity_id", "s.*")


def replay(events: DataFrame) -> DataFrame:
    """entity_id, version, state of every entity: deleted ones by their tombstone, others by the chain of accepted events."""
    live = folded(events).filter("accepted > 0").select("entity_id", "version", F.lit("live").alias("state"))
    return live.unionByName(tombstones(events).select("entity_id", F.col("version").cast("long").alias("version"), F.lit("deleted").alias("state")))


def conflicts(events: DataFrame) -> DataFrame:
    return folded(events).select("entity_id", F.explode("conflicts").alias("c")).select("entity_id", "c.*")


def history(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of a set of entities with the version before."""
    own = events.join(entities.select("entity_id").distinct().hint("merge"), "entity_id", "left_semi")
    return own.withColumn("before", F.lag("version").over(Window.partitionBy("entity_id").orderBy("sequence")))

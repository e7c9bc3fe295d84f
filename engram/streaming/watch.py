"""Folders of growing logs: each poll reads what files have gained since the last one, from their last complete record.

A manifest in a store says how far every file has been read, and a digest of that part. A file that still starts with it
has grown, and only what follows is taken; one that doesn't was written anew and starts a new epoch. Records and manifest
move together, so that a poll that was interrupted is made again as if it had never begun. (A stream of files reads a path
once and would never see a file grow.)
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources import snapshots
from engram.sources.snapshots import State
from engram.sources.stage_tables import materialize

LINES = "file string, epoch int, place long, line string"
FILES = "file string, epoch int, bytes long, consumed long, records long, digest string, modified timestamp, present boolean"
#: File names up to this number are sent to every task.
_SENT = 100_000


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, bytes and content of the files of a folder; content is read only where it is asked for."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def _manifest(spark: SparkSession, root: str, at: State) -> DataFrame:
    known = snapshots.table(spark, root, "files", at)
    return spark.createDataFrame([], FILES) if known is None else known


def poll(spark: SparkSession, path: str, root: str) -> State | None:
    """Read what is new in a folder into the store: its manifest `files` and its log `lines`. None if nothing has changed.

    A line counts once its newline is there, a file once it isn't empty. A file that is gone stays in the manifest as not present. Files are read
    whole (up to 2 GB each) where their time or size has changed, but only what follows the known part is parsed.
    """
    before = snapshots.state(spark, root)
    known = _manifest(spark, root, before)
    seen = _listing(spark, path).drop("content")
    old = known.select("file", F.col("bytes").alias("k_bytes"), F.col("modified").alias("k_modified"), "present")
    both = materialize(seen.join(old.hint("merge"), "file", "full_outer"), "listing")
    gone = both.filter("bytes is null and present").select("file")
    changed = both.filter("bytes is not null").filter(~(F.col("bytes").eqNullSafe(F.col("k_bytes")) & F.col("modified").eqNullSafe(F.col("k_modified")) & F.coalesce("present", F.lit(False))))
    n_changed = changed.count()
    if not n_changed and gone.isEmpty():
        return None
    since = changed.agg(F.min("modified").alias("m")).first()["m"]
    names = changed.select("file").hint("broadcast" if n_changed <= _SENT else "merge")
    body = _listing(spark, path).filter(F.col("modified") >= F.lit(since)) if n_changed else _listing(spark, path).limit(0)
    body = body.join(names, "file", "left_semi").join(known.select("file", "epoch", "consumed", "records", "digest").hint("merge"), "file", "left")
    grown = F.coalesce((F.octet_length("content") >= F.col("consumed")) & (F.sha2(F.substring("content", F.lit(1), F.col("consumed").cast("int")), 256) == F.col("digest")), F.lit(False))
    start = F.when(F.col("grown"), F.col("consumed")).otherwise(0)
    body = body.withColumn("grown", grown).withColumn("tail", F.substring("content", (start + 1).cast("int"), F.octet_length("content")))
    open_ = F.octet_length(F.substring_index(F.col("tail").cast("string"), "\n", -1))
    body = body.withColumn("whole", F.substring("tail", F.lit(1), (F.octet_length("tail") - open_).cast("int")))
    split = F.split(F.col("whole").cast("string"), "\n")
    consumed = start + F.octet_length("whole")
    read = materialize(body.select(
        "file", F.when(F.col("grown"), F.col("epoch")).otherwise(F.coalesce(F.col("epoch") + 1, F.lit(0))).alias("epoch"), "bytes", "modified", consumed.alias("consumed"),
        F.sha2(F.substring("content", F.lit(1), consumed.cast("int")), 256).alias("digest"), F.when(F.col("grown"), F.col("records")).otherwise(0).alias("first"), F.slice(split, F.lit(1), F.size(split) - 1).alias("lines"),
    ), "read")
    lines = read.select("file", "epoch", "first", F.posexplode("lines").alias("i", "line")).select("file", "epoch", (F.col("first") + F.col("i")).alias("place"), "line")
    fresh = read.select("file", "epoch", "bytes", "consumed", (F.col("first") + F.size("lines")).alias("records"), "digest", "modified", F.lit(True).alias("present"))
    stays = known.join(read.select("file").hint("merge"), "file", "left_anti").join(gone.withColumn("gone", F.lit(True)).hint("merge"), "file", "left").withColumn("present", F.col("present") & F.col("gone").isNull()).drop("gone")
    return snapshots.commit(spark, root, {"files": stays.unionByName(fresh)}, {"lines": lines}, before=before)


def lines(spark: SparkSession, root: str, at: State | None = None, since: State | None = None) -> DataFrame:
    """file, place, line of the current epoch of every file, in the form the readers of chat logs take; with `since`, of
    the files alone that have gained lines after that state, these files whole."""
    at = at or snapshots.state(spark, root)
    rows = snapshots.log(spark, root, "lines", LINES, at).join(_manifest(spark, root, at).select("file", "epoch").hint("merge"), ["file", "epoch"])
    if since is not None:
        rows = rows.join(rows.filter(F.col("state") > since.number).select("file").distinct().hint("merge"), "file", "left_semi")
    return rows.filter(F.trim("line") != "").select("file", "place", "line")


def watch(spark: SparkSession, path: str, root: str, apply: Callable[[State, State], None], polls: int | None = None, seconds: float = 60) -> int:
    """Poll a folder for ever, or so many times, and call apply(state before, state after) whenever it has changed; the
    first poll catches up with what is there. Returns how often it did."""
    moved, n = 0, 0
    while polls is None or n < polls:
        if n:
            time.sleep(seconds)
        before = snapshots.state(spark, root)
        after = poll(spark, path, root)
        if after is not None:
            apply(before, after)
            moved += 1
        n += 1
    return moved

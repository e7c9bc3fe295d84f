"""Versioned tables: every job writes new generations and then moves one pointer; readers keep the old ones.

A table has a folder per generation. A store is a folder of such tables with one pointer to a common state: which
generation of each table is current. The pointer moves last and by one file, so that whoever reads sees all tables of a
job or none, wherever the job was stopped; what it had written is written again, under the same numbers, when it is run
again. Numbers of batches are kept with the pointer, so that a batch that was finished isn't counted twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_POINTER = "state long, tables map<string, long>, batches map<string, long>, logs array<string>"


@dataclass(frozen=True)
class State:
    """What a store's pointer says: its number, the current generation of every table, and the last batch of every job."""

    number: int = 0
    tables: Mapping[str, int] = field(default_factory=dict)
    batches: Mapping[str, int] = field(default_factory=dict)


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).json(f"{root}/pointer")
    except AnalysisException:
        return None


def state(spark: SparkSession, root: str, number: int | None = None) -> State:
    """The current state of a store, or an earlier one; an empty one if nothing has been written."""
    rows = _pointers(spark, root)
    if rows is None:
        return State()
    last = (rows if number is None else rows.filter(F.col("state") <= number)).orderBy(F.desc("state")).first()
    return State(last["state"], dict(last["tables"] or {}), dict(last["batches"] or {})) if last else State()


def table(spark: SparkSession, root: str, name: str, at: State | None = None) -> DataFrame | None:
    """A table of a store as one state has it; None where that state has no such table."""
    generation = (at or state(spark, root)).tables.get(name)
    return None if generation is None else spark.read.parquet(f"{root}/{name}/generation={generation}")


def log(spark: SparkSession, root: str, name: str, schema: str, at: State | None = None) -> DataFrame:
    """An append-only table of a store: all that jobs up to one state have added to it, with the `state` that did. What
    a job wrote that never moved the pointer isn't in it."""
    at = at or state(spark, root)
    rows = _pointers(spark, root)
    states = [] if rows is None else [r["state"] for r in rows.filter((F.col("state") <= at.number) & F.array_contains("logs", name)).select("state").distinct().collect()]
    paths = [f"{root}/{name}/state={n}" for n in sorted(states)]
    return spark.read.schema(f"{schema}, state long").option("basePath", f"{root}/{name}").parquet(*paths) if paths else spark.createDataFrame([], f"{schema}, state long")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], logs: Mapping[str, DataFrame] | None = None, job: str | None = None, batch: int | None = None, before: State | None = None) -> State:
    """Write new generations of tables and additions to logs, and move the pointer once, after all of them; others stay.

    job and batch name the work: if the pointer has that batch already, nothing is written. `before` is the state that
    the tables were made from; if another job has moved the pointer since, that is an error, and nothing has moved.
    """
    now = state(spark, root)
    if job is not None and batch is not None and now.batches.get(job, -1) >= batch:
        return now
    if before is not None and before.number != now.number:
        raise RuntimeError(f"{root} has moved from state {before.number} to {now.number}")
    number = now.number + 1
    for name, df in tables.items():
        _write(df, f"{root}/{name}/generation={number}")
    for name, df in (logs or {}).items():
        _write(df, f"{root}/{name}/state={number}")
    done = {job: batch} if job is not None and batch is not None else {}
    return _point(spark, root, State(number, {**now.tables, **dict.fromkeys(tables, number)}, {**now.batches, **done}), list(logs or {}))


def _point(spark: SparkSession, root: str, to: State, logs: list[str]) -> State:
    """Move the pointer: one row in one file, which appears as a whole."""
    row = spark.createDataFrame([(to.number, dict(to.tables), dict(to.batches), logs)], _POINTER)
    row.coalesce(1).write.mode("append").json(f"{root}/pointer")
    return to


def stage(spark: SparkSession, root: str, name: str, df: DataFrame) -> int:
    """Write a generation of a table that no state points to yet; its number is for `activate`."""
    number = state(spark, root).number + 1
    _write(df, f"{root}/{name}/generation={number}")
    return number


def activate(spark: SparkSession, root: str, generations: Mapping[str, int], complete: bool) -> State:
    """Make these generations, written beforehand, the current ones of their tables, all at once, if the gate holds;
    otherwise the pointer stays. Readers of the state before aren't disturbed: its folders remain."""
    now = state(spark, root)
    if not complete:
        return now
    return _point(spark, root, State(now.number + 1, {**now.tables, **generations}, now.batches), [])


def current(spark: SparkSession, table: str) -> int:
    """The number of the current generation, 0 if there is none."""
    try:
        return spark.read.schema("generation long").json(f"{table}/pointer").agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).first()["g"]
    except AnalysisException:
        return 0


def write(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write the next generation, then point to it. A write that fails leaves the pointer where it was."""
    spark = df.sparkSession
    generation = current(spark, table) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/generation={generation}")
    spark.createDataFrame([(generation,)], "generation long").coalesce(1).write.mode("append").json(f"{table}/pointer")
    return generation


def read(spark: SparkSession, table: str, generation: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{table}/generation={generation or current(spark, table)}")


def append(df: DataFrame, table: str, at: str, batch: int) -> None:
    """Add a batch to an append-only table, by batch and date. A batch that comes again replaces what it wrote before,
    whole or in part, and nothing else, so that it counts once."""
    df.withColumn("date", F.to_date(at)).write.mode("overwrite").partitionBy("date").parquet(f"{table}/batch={batch}")


def appended(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """An append-only table with the batch and date of every row; empty where nothing was added yet."""
    try:
        return spark.read.schema(f"{schema}, batch int, date date").option("basePath", table).parquet(f"{table}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch int, date date")


def report(df: DataFrame, path: str) -> None:
    """A small summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)

"""Registered iterative and streaming queries. Most can't be written in SQL and are tested against plain walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from engram.operators import consolidate, diffusion, evaluation, fusion
from engram.params import DEFAULTS
from engram.plans import retrieval_queries as R
from engram.plans import views
from engram.sources import snapshots
from engram.sources.stage_tables import materialize, stage_path
from engram.streaming import cycle, jobs


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = views.frame(spark, sf_dir, "story_state").filter("not deleted and not archived and not no_vector")
    return R.stories(spark, sf_dir).join(state.select("story_id").hint("merge"), "story_id", "left_semi")


def _diffused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = materialize(R.hybrid(spark, sf_dir), "hits")
    seeds = hits.filter("rank <= 3 and vector_similarity is not null").select("query_id", "story_id", "similarity")
    return hits, diffusion.diffuse(seeds, views.frame(spark, sf_dir, "edges"), _active(spark, sf_dir), DEFAULTS)


def graph_diffusion_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _diffused(spark, sf_dir)
    return found.select("query_id", "story_id", F.round("score", 6).alias("score"), "seed", "hop", "tokens")


def hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with diffusion: direct and graph hits as one ranking."""
    hits, found = _diffused(spark, sf_dir)
    return diffusion.merge(hits, found, 10).withColumn("score", F.round("score", 6))


def strategy_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of four strategies on the same queries."""
    queries, stories = views.queries(spark, sf_dir), R.stories(spark, sf_dir)
    qrels = queries.select("query_id", F.col("query_id").alias("story_id"))
    hits, found = _diffused(spark, sf_dir)
    runs = {
        "direct_vector": fusion.vector_lane(queries, stories, 10, 0.5).select("query_id", "story_id", "rank"),
        "hybrid": hits.select("query_id", "story_id", "rank"),
        "hybrid_graph": diffusion.merge(hits, found, 10).select("query_id", "story_id", "rank"),
        "hybrid_reranker": fusion.overlap_rerank(queries, hits, stories, 8).select("query_id", "story_id", "rank"),
    }
    out = None
    for name, ranked in runs.items():
        row = evaluation.recall_metrics(ranked, qrels).agg(F.lit(name).alias("strategy"), F.round(F.avg("recall_3"), 6).alias("recall_3"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def batch_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as new stories against the store of the other stories."""
    new = views.queries(spark, sf_dir)
    store = R.stories(spark, sf_dir).filter("story_id % 20 <> 0")
    return consolidate.batch_consolidation(new, store)


def _arrived(source: DataFrame, name: str, order: str, files: int = 3) -> tuple[str, str]:
    """A folder to which rows were added in order of a column, a file at a time, and a place for a stream's checkpoint."""
    spark = source.sparkSession
    path = stage_path(spark, f"{name}-in")
    rows = materialize(source, name)
    ends = [float("-inf"), *rows.approxQuantile(order, [i / files for i in range(1, files)], 0.01), float("inf")]
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        rows.filter((F.col(order) > low) & (F.col(order) <= high)).coalesce(1).write.mode("append").parquet(path)
    return path, stage_path(spark, f"{name}-state")


def _streamed(spark: SparkSession, sf_dir: str, name: str, source: DataFrame, job, mode: str, order: str) -> DataFrame:
    """Run a job over a folder of Parquet files, a file a batch, until it has read them all."""
    path, checkpoint = _arrived(source, name, order)
    out = stage_path(spark, f"{name}-out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = job(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(out)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.frame(spark, sf_dir, "memory_events")
    out = _streamed(spark, sf_dir, "replay", events, jobs.replay, "append", "sequence")
    return out.select("entity_id", "sequence", "outcome", "version")


def stream_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), "role", "text")
    out = _streamed(spark, sf_dir, "transcripts", messages, jobs.transcripts, "update", "place")
    return out.groupBy("session_id").agg(F.max_by("raw_content", "batch").alias("raw_content"), F.max_by("conclusion", "batch").alias("conclusion"))


def stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the last 200 diagnostics of every mode, by a stream that keeps no more than those."""
    rows = views.frame(spark, sf_dir, "diagnostics").select("request_id", "ts", "mode", "total_ms", "embed_ms", "vector_ms")
    path, checkpoint = _arrived(rows, "diagnostics", "request_id")
    root = stage_path(spark, "diagnostics-store")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.diagnostics(source, root, ["total_ms", "embed_ms", "vector_ms"], checkpoint).start().awaitTermination()
    return snapshots.table(spark, root, "summary")


def full_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions consolidated into stories, three batches of them, each moving all tables of a store at once."""
    sessions = views.frame(spark, sf_dir, "sessions").select(F.col("conv_id").alias("session_id"), "problem_desc", "conclusion")
    path, checkpoint = _arrived(sessions, "sessions", "session_id")
    root = stage_path(spark, "cycle-store")
    source = spark.readStream.schema(sessions.schema).option("maxFilesPerTrigger", 1).parquet(path)
    cycle.run(source, root, checkpoint).start().awaitTermination()
    stories, edges = snapshots.table(spark, root, "stories"), snapshots.table(spark, root, "edges")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("story_id")).groupBy("story_id").agg(F.count("*").alias("n_edges"))
    told = snapshots.log(spark, root, "events", cycle.EVENTS).groupBy(F.col("entity_id").alias("story_id")).agg(F.count("*").alias("n_events"), F.max("version").alias("last_version"))
    out = stories.join(told.hint("merge"), "story_id").join(ends.hint("merge"), "story_id", "left")
    return out.select("story_id", "version", F.size("session_ids").alias("n_sessions"), "n_events", "last_version", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


QUERIES = {f.__name__: f for f in (graph_diffusion_budgeted, hybrid_graph, strategy_ablation, batch_consolidation, stream_replay, stream_transcripts, stream_diagnostics, full_cycle)}
SQL: dict[str, str] = {
    "stream_diagnostics": f"""WITH {views.ctes('diagnostics')}, latest AS (SELECT * FROM diagnostics QUALIFY row_number() OVER (PARTITION BY mode ORDER BY ts DESC, request_id DESC) <= 200),
long AS (SELECT mode, 'total_ms' AS stage, total_ms AS ms FROM latest UNION ALL SELECT mode, 'embed_ms', embed_ms FROM latest UNION ALL SELECT mode, 'vector_ms', vector_ms FROM latest)
SELECT mode, stage, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99 FROM long GROUP BY mode, stage""",
}

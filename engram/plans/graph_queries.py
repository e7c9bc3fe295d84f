"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import graph
from engram.plans import views
from engram.plans.views import ctes


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "edges")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame(spark, sf_dir, "story_state").filter("not deleted and not archived and not no_vector")


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_edges(spark, sf_dir), _active(spark, sf_dir))


def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _active(spark, sf_dir)
    return graph.related(active, _edges(spark, sf_dir), active)


def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def superseded_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _active(spark, sf_dir)
    return active.select("story_id").join(graph.superseded(_edges(spark, sf_dir), active), "story_id", "left_anti")


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _active(spark, sf_dir).filter("story_id % 10 = 0")
    return graph.two_hop(seeds, _edges(spark, sf_dir))


def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("not deleted").groupBy("edge_type").agg(F.count("*").alias("n"))


def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _active(spark, sf_dir).filter("label = 3").select(F.col("story_id").alias("node"))
    return graph.both_ways(_edges(spark, sf_dir)).join(some, "node", "left_semi")


def edge_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with a legacy type, parents turned round and weights out of range, brought into form."""
    raw = _edges(spark, sf_dir)
    odd = raw.withColumns({
        "edge_type": F.when(F.col("edge_id") % 9 == 0, F.lit("sibling")).otherwise(F.col("edge_type")),
        "weight": F.when(F.col("edge_id") % 7 == 0, F.col("weight") + 0.5).otherwise(F.col("weight")),
        "source_id": F.when((F.col("edge_type") == "parent_child") & (F.col("edge_id") % 2 == 0), F.col("target_id")).otherwise(F.col("source_id")),
        "target_id": F.when((F.col("edge_type") == "parent_child") & (F.col("edge_id") % 2 == 0), F.col("source_id")).otherwise(F.col("target_id")),
    })
    return graph.normalize(odd, views.frame(spark, sf_dir, "story_state"))


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with where they come from; two incoming ones may be the same edge from its two ends."""
    edges = _edges(spark, sf_dir)
    text = lambda c: c.cast("string")
    made = lambda *pairs: F.map_filter(F.create_map(*(x for name, value in pairs for x in (F.lit(name), value))), lambda k, v: v.isNotNull())
    base = edges.filter("edge_id % 5 <> 0").withColumn("version", F.lit(1).cast("long")).withColumn("provenance", made(("by", text(F.col("edge_id") % 4)), ("source", F.when(F.col("edge_id") % 2 == 0, F.lit("import")))))
    ends = edges.filter("edge_id % 3 = 0").select("edge_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", (F.col("weight") + F.when(F.col("edge_id") % 7 == 0, 0.0).otherwise(0.2)).alias("weight"))
    incoming = ends.withColumn("provenance", made(("by", F.when(F.col("edge_id") % 4 > 0, text(F.col("edge_id") % 8))), ("run", F.when(F.col("edge_id") % 11 == 0, F.lit("r")))))
    out = graph.upsert(graph.combine(base, "edge_id"), incoming, "edge_id")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("provenance")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumn("weight", F.round("weight", 6)).withColumn("provenance", said)


def edge_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.frame(spark, sf_dir, "recall_lists")
    pairs = graph.co_recall_pairs(lists, ["user_id", "day"]).select("a", "b")
    return graph.reinforce(_edges(spark, sf_dir), pairs).select("edge_id", F.round("weight", 6).alias("weight"))


def edge_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    pairs = edges.filter("edge_id % 11 = 0").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.when(F.col("edge_id") % 2 == 0, F.col("edge_type")).alias("edge_type"))
    return graph.delete_pairs(edges, pairs).select("edge_id", "deleted")


def co_recall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_recall_pairs(views.frame(spark, sf_dir, "recall_lists"), ["user_id", "day"])


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on order lines: which parts are bought together more than once."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("story_id"))
    return graph.co_recall_pairs(lines, ["l_orderkey"]).filter("n > 1")


def co_recall_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.feedback(graph.canonical(_edges(spark, sf_dir)), views.frame(spark, sf_dir, "recall_lists"), ["user_id", "day"], _active(spark, sf_dir))
    return out.groupBy("source_id", "target_id", "edge_type").agg(F.round(F.max("weight"), 6).alias("weight"), F.min("deleted").alias("deleted"))


def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).withColumn("edge_type", F.when(F.col("edge_type") == "temporal", "co_recall").otherwise(F.col("edge_type")))
    out = graph.decay(edges, F.to_date(F.lit("2024-06-01")))
    return out.select("edge_id", F.round("weight", 6).alias("weight"), "deleted")


_TWO_WAYS = """seen AS (SELECT source_id AS node, target_id AS neighbor, edge_id, edge_type, weight, CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN 'outbound' ELSE 'undirected' END AS direction FROM edges WHERE NOT deleted
    UNION ALL SELECT target_id, source_id, edge_id, edge_type, weight, CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN 'inbound' ELSE 'undirected' END FROM edges WHERE NOT deleted),
active AS (SELECT * FROM story_state WHERE NOT deleted AND NOT archived AND NOT no_vector),
passable AS (SELECT * FROM seen WHERE direction = 'undirected' OR edge_type = 'parent_child' OR (edge_type = 'supersedes' AND direction = 'inbound') OR (edge_type IN ('temporal', 'causal') AND direction = 'outbound'))"""
_BASE = f"WITH {ctes('edges', 'story_state')}, {_TWO_WAYS}"
_LISTS = f"WITH {ctes('edges', 'story_state', 'recall_lists')}"
_CANON = "CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN {0} ELSE {1}({0}, {2}) END"


def _canon(table: str, extra: str = "") -> str:
    return f"""SELECT CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN source_id ELSE least(source_id, target_id) END AS source_id,
      CASE WHEN edge_type IN ('temporal', 'causal', 'parent_child', 'supersedes') THEN target_id ELSE greatest(source_id, target_id) END AS target_id, edge_type, greatest(0, least(1, weight)) AS weight{extra} FROM {table}"""


_PAIRS_SQL = "pairs AS (SELECT a.story_id AS a, b.story_id AS b, count(*) AS n FROM recall_lists a JOIN recall_lists b ON a.user_id = b.user_id AND a.day = b.day AND a.story_id < b.story_id GROUP BY ALL)"

SQL = {
    "graph_neighbors": f"""{_BASE}, counts AS (SELECT s.node, count(*) AS all_n, count(*) FILTER (WHERE p.edge_id IS NOT NULL) AS n FROM seen s LEFT JOIN passable p ON p.node = s.node AND p.edge_id = s.edge_id GROUP BY s.node)
SELECT p.node, p.neighbor, p.edge_id, p.edge_type, p.direction, p.weight, row_number() OVER (PARTITION BY p.node ORDER BY p.weight DESC, p.edge_id) AS place, c.all_n - c.n AS suppressed, c.n > 8 AS truncated
FROM passable p JOIN counts c USING (node) WHERE p.node IN (SELECT story_id FROM active) QUALIFY place <= 8""",
    "related_topk": f"""{_BASE}, one AS (SELECT * FROM seen WHERE node IN (SELECT story_id FROM active) AND neighbor IN (SELECT story_id FROM active) QUALIFY row_number() OVER (PARTITION BY node, neighbor ORDER BY weight DESC, edge_id) = 1)
SELECT node AS story_id, neighbor, edge_id, edge_type, direction, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id) AS place FROM one QUALIFY place <= 5""",
    "degree_topk": f"{_BASE} SELECT node, count(*) AS degree FROM seen GROUP BY node",
    "superseded_suppressed": f"{_BASE} SELECT story_id FROM active WHERE story_id NOT IN (SELECT target_id FROM edges WHERE edge_type = 'supersedes' AND NOT deleted AND source_id IN (SELECT story_id FROM active))",
    "graph_two_hop": f"""{_BASE}, steps AS (SELECT node, neighbor, weight * CASE edge_type WHEN 'semantic' THEN 0.85 WHEN 'temporal' THEN 0.80 WHEN 'causal' THEN 1.0 WHEN 'same_environment' THEN 0.90 WHEN 'parent_child' THEN 0.95 ELSE 1.0 END::DOUBLE
    * CASE WHEN edge_type = 'parent_child' AND direction = 'inbound' THEN 0.9 ELSE 1.0 END::DOUBLE AS step FROM passable),
one AS (SELECT story_id AS seed, neighbor AS node, max(step) AS p FROM active JOIN steps ON node = story_id WHERE story_id % 10 = 0 AND neighbor <> story_id GROUP BY ALL),
two AS (SELECT seed, neighbor AS node, max(p * step) AS p FROM one JOIN steps USING (node) WHERE neighbor <> seed GROUP BY ALL),
reached AS (SELECT seed, node, round(p, 12) AS score, 1 AS hop FROM one UNION ALL SELECT seed, node, round(p * 0.82::DOUBLE, 12), 2 FROM two)
SELECT * FROM (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY score DESC, hop) = 1) WHERE score >= 0.55""",
    "edge_type_counts": f"{_BASE} SELECT edge_type, count(*) AS n FROM edges WHERE NOT deleted GROUP BY edge_type",
    "edge_listing": f"{_BASE} SELECT node, neighbor, direction, edge_id, edge_type, weight FROM seen WHERE node IN (SELECT story_id FROM active WHERE label = 3)",
    "edge_normalize": f"""{_BASE}, odd AS (SELECT edge_id, CASE WHEN edge_id % 9 = 0 THEN 'semantic' ELSE edge_type END AS edge_type, CASE WHEN edge_id % 7 = 0 THEN weight + 0.5 ELSE weight END AS weight, deleted, source_id, target_id FROM edges),
form AS ({_canon("odd", ", deleted")})
SELECT source_id, target_id, edge_type, max(weight) AS weight, bool_and(deleted) AS deleted FROM form GROUP BY source_id, target_id, edge_type""",
    "edge_upsert": f"""{_BASE}, base_rows AS ({_canon("(SELECT * FROM edges WHERE edge_id % 5 <> 0)", ", deleted, edge_id, (edge_id % 4)::VARCHAR AS who, CASE WHEN edge_id % 2 = 0 THEN 'import' END AS source")}),
base AS (SELECT source_id, target_id, edge_type, max(weight) AS weight, bool_and(deleted) AS deleted, 1 + (count(*) > 1)::INT AS version, arg_max(who, edge_id) AS who, max(source) AS source FROM base_rows GROUP BY source_id, target_id, edge_type),
fresh_rows AS ({_canon("(SELECT edge_id, target_id AS source_id, source_id AS target_id, edge_type, weight + CASE WHEN edge_id % 7 = 0 THEN 0 ELSE 0.2 END::DOUBLE AS weight FROM edges WHERE edge_id % 3 = 0)", ", edge_id")}),
fresh AS (SELECT source_id, target_id, edge_type, max(weight) AS new, arg_max((edge_id % 8)::VARCHAR, edge_id) FILTER (WHERE edge_id % 4 > 0) AS who, max(CASE WHEN edge_id % 11 = 0 THEN 'r' END) AS run FROM fresh_rows GROUP BY source_id, target_id, edge_type)
SELECT coalesce(b.source_id, f.source_id) AS source_id, coalesce(b.target_id, f.target_id) AS target_id, coalesce(b.edge_type, f.edge_type) AS edge_type, round(greatest(b.weight, f.new), 6) AS weight, CASE WHEN f.new IS NOT NULL THEN false ELSE b.deleted END AS deleted,
  (coalesce(b.version, 0) + CASE WHEN f.new IS NOT NULL AND (b.weight IS NULL OR b.deleted OR f.new > b.weight OR f.who <> b.who OR f.run IS NOT NULL) THEN 1 ELSE 0 END)::BIGINT AS version,
  concat_ws(';', 'by=' || coalesce(f.who, b.who), 'run=' || f.run, 'source=' || b.source) AS provenance
FROM base b FULL JOIN fresh f ON b.source_id = f.source_id AND b.target_id = f.target_id AND b.edge_type = f.edge_type""",
    "edge_reinforce": f"""{_LISTS}, {_PAIRS_SQL}, chosen AS (SELECT edge_id FROM edges JOIN pairs ON least(source_id, target_id) = a AND greatest(source_id, target_id) = b WHERE NOT deleted
    QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY edge_type <> 'semantic', weight DESC, edge_id) = 1)
SELECT edge_id, round(CASE WHEN edge_id IN (SELECT edge_id FROM chosen) THEN least(1.0, weight + 0.1) ELSE weight END, 6) AS weight FROM edges""",
    "edge_soft_delete": f"""{_BASE}, listed AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, CASE WHEN edge_id % 2 = 0 THEN edge_type END AS kind FROM edges WHERE edge_id % 11 = 0)
SELECT edge_id, deleted OR EXISTS (SELECT 1 FROM listed WHERE lo = least(source_id, target_id) AND hi = greatest(source_id, target_id) AND (kind IS NULL OR kind = edge_type)) AS deleted FROM edges""",
    "co_recall_pairs": f"{_LISTS}, {_PAIRS_SQL} SELECT a, b, n FROM pairs",
    "basket_pairs": """WITH items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) > 1""",
    "co_recall_feedback": f"""{_LISTS}, active AS (SELECT story_id FROM story_state WHERE NOT deleted AND NOT archived AND NOT no_vector),
used AS (SELECT * FROM recall_lists WHERE story_id IN (SELECT story_id FROM active)), pairs AS (SELECT a.story_id AS a, b.story_id AS b, count(*) AS n FROM used a JOIN used b ON a.user_id = b.user_id AND a.day = b.day AND a.story_id < b.story_id GROUP BY ALL),
form AS ({_canon("edges", ", deleted")}),
grown AS (SELECT source_id, target_id, edge_type, CASE WHEN n IS NOT NULL AND NOT deleted THEN least(1.0, weight + 0.1 * n) ELSE weight END AS weight, deleted FROM form LEFT JOIN pairs ON source_id = a AND target_id = b
    UNION ALL SELECT a, b, 'co_recall', least(1.0, 0.1 * n), false FROM pairs)
SELECT source_id, target_id, edge_type, round(max(weight), 6) AS weight, bool_and(deleted) AS deleted FROM grown GROUP BY source_id, target_id, edge_type""",
    "edge_decay": f"""{_BASE}, aged AS (SELECT edge_id, CASE WHEN edge_type = 'temporal' AND NOT deleted THEN weight * pow(0.5, date_diff('day', updated_day, DATE '2024-06-01') / 30.0) ELSE weight END AS weight, edge_type = 'temporal' AS fades, deleted FROM edges)
SELECT edge_id, round(weight, 6) AS weight, deleted OR (fades AND weight < 0.02) AS deleted FROM aged""",
}

QUERIES = {name: globals()[name] for name in SQL}

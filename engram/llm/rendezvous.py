"""Sharding by rendezvous hashing: every shard draws a number for a row's key, and the best draw takes the row.

A draw depends on the key and the shard alone, so that shards can be added, taken away or weighed anew without a table
of places: one more shard takes rows only into itself. Everything is a Spark expression but the order of the slots, which
comes from one sort of narrow rows by ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import named, rest_struct

#: Bits of a draw: what a double holds beside one half.
_BITS = 52


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    """What it costs a shard to take the key: exponential with the weight as rate, so that shares follow weights."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string")).cast("binary")), 1, _BITS // 4)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << _BITS)
    return F.struct((-F.ln(u) / weight).alias("cost"), shard.alias("shard"))


def best_draw(key: Column, weights: Mapping[int, float]) -> Column:
    """cost and shard of the cheapest draw; equal costs go to the smaller shard. A shard of weight 0 takes nothing."""
    shards = sorted((int(s), float(w)) for s, w in weights.items() if w > 0)
    if not shards:
        raise ValueError("no shard has a weight above 0")
    table = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight")) for s, w in shards))
    return F.array_min(F.transform(table, lambda s: _draw(key, s["shard"], s["weight"])))


def place(docs: DataFrame, weights: Mapping[int, float], added: Mapping[int, float] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The shard of every row, its slot there, and its shard once those in `added` have joined.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot (gapless from 0 in each shard, by
    doc_id, then text_crc32 and size), grown_shard (null without `added`) and the columns to carry along in `rest`.

    A null text has no bytes. Null ids are one key, which is first in its shard; rows that repeat an id are in one shard
    with slots of their own, and rows that are equal throughout may swap theirs. An empty table gives an empty one. Very
    long texts are only measured. Other columns are ignored, whatever their names.

    A key or shard that holds a third of all rows is split by the sort, whose ranges end with a row number; what is
    broadcast has a row per range and shard.
    """
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        best_draw(key, weights).alias("best"),
        *rest_struct(docs, carry),
    )
    grown = F.lit(None).cast("int")
    if added:
        if set(added) & set(weights):
            raise ValueError("added shards must be new ones")
        grown = F.least("best", best_draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), added))["shard"]
    rest = ["rest"] if carry else []
    rows = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), grown.alias("grown_shard"), *rest)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    order = ("shard", "doc_id", "text_crc32", "size", "row")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.drop("row"), "shard-order")
    ranges = ranged.groupBy("shard", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    ranges = ranges.select(F.col("shard").alias("of"), F.col("range"), shift)
    met = ranged.join(F.broadcast(ranges), (F.col("shard") == F.col("of")) & (F.shiftright("at", 33) == F.col("range")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard", *rest)


def write_shards(docs: DataFrame, weights: Mapping[int, float], path: str, rows_per_file: int = 100_000) -> None:
    """Write whole rows as Parquet, a folder per shard, in files of consecutive slots; the columns are those of docs beside
    `shard` and `slot`. Every file is the work of one task, and no task holds more than its rows.

    A column of docs that is called shard or slot would clash with the folder's: that is an error.
    """
    if clash := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    placed = place(docs, weights, carry=tuple(docs.columns))
    rows = placed.select(*(F.col("rest").getField(c).alias(c) for c in docs.columns), "shard", "slot")
    part = F.floor(F.col("slot") / rows_per_file)
    rows.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def rendezvous_sharding(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The row per document that the query reports: equal shards, and one more."""
    out = place(docs, dict.fromkeys(range(shards), 1.0), {shards: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_entry(byte: int) -> int:
    """What one byte does to the CRC-32 register."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS key, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, key, cast(size AS BIGINT) AS size,
         xor(4294967295, list_reduce(
           list_transform(regexp_extract_all(bytes, '..'), lambda h: cast('0x' || h AS BIGINT)),
           lambda c, b: xor(c >> 8, {[_crc_entry(b) for b in range(256)]}[cast(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295)) AS text_crc32
  FROM sized
), draws AS (
  SELECT s.*, k.shard, -ln((cast('0x' || substring(md5(key || '/' || k.shard), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS cost
  FROM (SELECT row_number() OVER () AS row, * FROM summed) s, (SELECT unnest(range(41)) AS shard) k
), placed AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(text_crc32) AS text_crc32,
         arg_min(shard, cost) FILTER (WHERE shard < 40) AS shard, arg_min(shard, cost) AS grown_shard
  FROM draws GROUP BY row
)
SELECT doc_id, size, text_crc32, 'key' AS law, cast(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       cast(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""

"""Rendezvous sharding: sizes and sums of the text, slots, moves, weights, files, and the query's SQL."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

from engram.llm import entry, rendezvous

from .conftest import texts


def plain_shard(doc_id, shards):
    key = "" if doc_id is None else str(doc_id)
    cost = lambda s: -math.log((int(md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return min(range(shards), key=lambda s: (cost(s), s))


def test_query_on_awkward_rows(docs):
    clash = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(None)).withColumn("best", F.lit(1))
    out = rendezvous.rendezvous_sharding(clash).collect()
    want = Counter()
    for i, t in texts():
        raw = (t or "").encode()
        want[i, len(raw) + 16, zlib.crc32(raw), "key", plain_shard(i, 40), plain_shard(i, 41)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = lambda r: (r["shard"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    assert [order(r) for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))] == sorted(map(order, out))


def test_sql(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["op12_rendezvous_sharding"](spark, str(tmp_path))
    want = c.sql(entry.oracle_sql()["op12_rendezvous_sharding"])
    assert want.columns == got.columns
    assert Counter(want.fetchall()) == Counter(map(tuple, got.collect()))


def test_a_hot_shard_is_split_over_ranges(spark):
    """Two thirds of the rows share a key; slots are gapless all the same, over several ranges of one shard."""
    rows = spark.range(0, 6000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    out = rendezvous.place(rows, dict.fromkeys(range(5), 1.0)).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b"))
    found = out.collect()
    assert sum(r["n"] for r in found) == 6000 and max(r["n"] for r in found) > 4000
    assert all((r["d"], r["a"], r["b"]) == (r["n"], 0, r["n"] - 1) for r in found)


@pytest.mark.parametrize(("weights", "added"), [({0: 1.0, 1: 1.0, 2: 1.0}, {3: 1.0}), ({0: 1.0, 5: 3.0}, {7: 4.0}), ({1: 2.0, 2: 0.0}, {3: 2.0, 4: 1.0})])
def test_weights_and_moves(spark, weights, added):
    n = 20_000
    out = rendezvous.place(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), weights, added).collect()
    for of, name in ((weights, "shard"), (weights | added, "grown_shard")):
        share = Counter(r[name] for r in out)
        assert set(share) == {s for s, w in of.items() if w > 0}
        for s, w in of.items():
            p = w / sum(of.values())
            assert abs(share[s] - n * p) <= 5 * math.sqrt(n * p * (1 - p))
    assert all(r["grown_shard"] == r["shard"] or r["grown_shard"] in added for r in out)
    again = rendezvous.place(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), weights | added).collect()
    assert {r["doc_id"]: r["grown_shard"] for r in out} == {r["doc_id"]: r["shard"] for r in again}


def test_clashing_or_missing_shards(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        rendezvous.place(rows, {0: 1.0}, {0: 1.0})
    with pytest.raises(ValueError):
        rendezvous.place(rows, {0: 0.0})
    with pytest.raises(ValueError):
        rendezvous.write_shards(rows.withColumn("slot", F.lit(1)), {0: 1.0}, "unused")


def test_shards_as_files(spark, docs, tmp_path):
    """Whole rows come back, and no file holds more rows than asked for."""
    wide = docs.withColumn("a.b", F.lit("marks in the name"))
    rendezvous.write_shards(wide, {0: 1.0, 1: 2.0}, f"{tmp_path}/shards", rows_per_file=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    names = [f"`{c}`" for c in wide.columns]
    assert Counter(map(tuple, back.select(*names).collect())) == Counter(map(tuple, wide.select(*names).collect()))
    files = back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards"))
    assert all(r["n"] <= 4 and r["shards"] == 1 for r in files.collect())
    placed = {(r["doc_id"], r["slot"]) for r in rendezvous.place(wide, {0: 1.0, 1: 2.0}).filter("doc_id > 9").collect()}
    assert {(r["doc_id"], r["slot"]) for r in back.filter("doc_id > 9").collect()} == placed


def test_an_empty_table(empty):
    assert rendezvous.rendezvous_sharding(empty).count() == 0

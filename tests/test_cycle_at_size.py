"""What the full cycle does at size: copies are searched once, few blocks, links thinned out; the same results as before."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import consolidate, representations, vector


def units(n, dimension, seed, kinds):
    """Unit vectors around a few centres, with copies."""
    rng = np.random.default_rng(seed)
    found = rng.normal(size=(kinds, dimension))[rng.integers(0, kinds, n)] + 0.35 * rng.normal(size=(n, dimension))
    found[n // 2 :] = found[rng.integers(0, n // 2, n - n // 2)]
    return (found / np.linalg.norm(found, axis=1)[:, None]).tolist()


@pytest.fixture(scope="module")
def tables(spark):
    new = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(units(150, 24, 1, 12))] + [(2000, None)], "query_id long, vector array<double>")
    store = spark.createDataFrame([(i, v) for i, v in enumerate(units(120, 24, 2, 12))] + [(500, None)], "story_id long, embedding array<double>")
    nearer = new.filter("query_id % 3 = 0").select((F.col("query_id") - 400).alias("story_id"), F.col("vector").alias("embedding"))
    return new.repartition(3), store.unionByName(nearer).repartition(3)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_near_ones_are_the_near_ones_of_all(spark, tables, monkeypatch):
    new, store = tables
    rows = vector.vector_topk(new, store, 5)
    for least in (0.3, 0.75, 0.999):
        want = plain(rows.filter(F.col("similarity") >= least))
        assert want and plain(vector.vector_topk(new, store, 5, least=least)) == want
    monkeypatch.setattr(vector, "NUMBERS", 24 * 7)
    monkeypatch.setattr(vector, "PACK", 5)
    monkeypatch.setattr(vector, "ROWS", 2)
    assert plain(vector.vector_topk(new, store, 5, least=0.75)) == plain(rows.filter("similarity >= 0.75"))


def test_later_pairs_are_half_of_all(spark, tables, monkeypatch):
    new, _ = tables
    stories = new.select(F.col("query_id").alias("story_id"), F.col("vector").alias("embedding"))
    want = plain(vector.vector_pairs(new, stories, 0.8).filter("query_id < story_id"))
    monkeypatch.setattr(vector, "ROWS", 16)
    for rows in (new, new.sort("query_id")):
        assert want and plain(vector.vector_pairs(rows, stories.sort("story_id"), 0.8, later=True)) == want


def test_a_block_is_bounded_by_its_numbers(spark, monkeypatch):
    """At 64 dimensions 4 times as many queries in a block as before, so that there are fewer jobs."""
    rows = spark.range(10_000).selectExpr("id AS query_id", "transform(sequence(0, 63), i -> cast(id + i AS double)) AS vector").coalesce(2)
    blocks = list(vector._blocks(rows, None))
    assert [len(ids) for ids, *_ in blocks] == [10_000] and sorted(blocks[0][0]) == list(range(10_000))
    assert (blocks[0][1] == blocks[0][0][:, None] + np.arange(64)).all()
    monkeypatch.setattr(vector, "NUMBERS", 64 * 4096)
    assert [len(ids) for ids, *_ in vector._blocks(rows, None)] == [4096, 4096, 1808]


def one_after_another(rows, least):
    leads, out = [], {}
    for i, v in sorted(rows):
        near = [j for j, w in leads if round(float(np.dot(v, w)), 4) >= least]
        out[i] = near[0] if near else i
        if not near:
            leads.append((i, v))
    return out


def test_copies_are_compared_once_and_follow_the_first(spark, tables, monkeypatch):
    new, store = tables
    held = [(r["query_id"], r["vector"]) for r in new.collect() if r["vector"]]
    seen = []
    pairs = consolidate.near_pairs
    monkeypatch.setattr(consolidate, "near_pairs", lambda rows, least: seen.append(rows.count()) or pairs(rows, least))
    got = {r["query_id"]: (r["branch"], r["target"]) for r in consolidate.batch_consolidation(new, store.filter("story_id < 0")).collect()}
    want = one_after_another(held, 0.85) | {2000: 2000}
    assert got == {i: ("create", None) if i == first else ("merge", first) for i, first in want.items()}
    assert seen == [len({tuple(v) for _, v in held}) + 1] and seen[0] < 100


@pytest.mark.parametrize("few", [0, 20, 100_000])
def test_leaders_of_chains_and_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(consolidate, "FEW_LINKS", few)
    rng = random.Random(few)
    links = [(i, i + 1) for i in range(7)] + [(20, i) for i in range(21, 40)] + [tuple(sorted(rng.sample(range(40, 70), 2))) for _ in range(40)]
    near = defaultdict(set)
    for a, b in links:
        near[b].add(a)
    want = {}
    for i in range(75):
        own = sorted(a for a in near[i] if want[a] == a)
        want[i] = own[0] if own else i
    got = consolidate.leaders(spark.createDataFrame(links, "a long, b long"), spark.range(75).withColumnRenamed("id", "story_id"))
    assert {r["story_id"]: r["leader"] for r in got.collect()} == want


def test_vectors_in_their_rows_are_the_same(spark):
    texts = ["Alpha beta, beta GAMMA", "", "...", "straße 漢字 STRASSE", "die tz.", None, "x " * 5000] + [f"w{i} w{i % 7} and {i}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {r["id"]: r["vector"] for r in representations.hashed_vectors(rows, ["id"]).collect()}
    got = representations.with_hashed_vectors(rows, F.col("text")).collect()
    assert {r["id"]: r["vector"] for r in got if r["vector"]} == want and len(got) == len(texts)
    assert {r["id"]: r["text"] for r in got} == dict(enumerate(texts))

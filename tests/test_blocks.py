"""Many small blocks give what one block gives, and order statistics are exact on ties, nulls and one hot group."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from engram.operators import evaluation, lexical, vector


def unit(rng):
    v = [rng.gauss(0, 1) for _ in range(8)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_blocks_of_queries_and_slices_of_stories(spark, monkeypatch):
    rng = random.Random(5)
    stories = [(i, unit(rng) if i % 9 else None, ["a", "b", None][i % 3], f"w{i % 5} x{i % 7}") for i in range(40)]
    stories += [(40 + i, stories[1][1], "a", "w1") for i in range(4)]  # ties
    s = spark.createDataFrame(stories, "story_id long, embedding array<double>, kind string, content string").withColumns({f: F.lit("") for f in ("title", "abstract", "keywords")})
    q = spark.createDataFrame([(i, unit(rng), ["a", "b", "z"][i % 3], f"w{i % 5}") for i in range(11)] + [(99, None, "a", "x3")], "query_id long, vector array<double>, kind string, text string")

    def answers():
        plain = lambda df: sorted(tuple(r) for r in df.collect())
        found = [plain(vector.vector_topk(q, s, 5)), plain(vector.vector_topk(q, s, 5, unit=False, scope="kind")), plain(vector.vector_pairs(q, s, 0.3)), plain(lexical.lexical_topk(q, s, 6))]
        return found, [plain(vector.vector_topk(q.filter("false"), s, 5)), plain(lexical.lexical_topk(q.filter("false"), s, 5))]

    once = answers()
    assert all(once[0]) and not any(once[1])
    monkeypatch.setattr(vector, "BLOCK", 3)
    monkeypatch.setattr(vector, "SLICE", 2)
    monkeypatch.setattr(lexical, "BLOCK", 2)
    assert answers() == once


def test_order_statistics(spark):
    rng = random.Random(6)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(500)] + [("hot", rng.random()) for _ in range(500)] + [("one", 7.0), ("none", None), ("some", None), ("some", 2.0), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "mode string, ms double")
    shares = (0.0, 0.5, 0.95, 1.0)
    out = {r["mode"]: r for r in evaluation.order_statistics(df, ["mode"], "ms", shares).collect()}
    assert set(out) == {"hot", "one", "none", "some", None}
    for mode, r in out.items():
        held = sorted(v for m, v in rows if m == mode and v is not None)
        for i, share in enumerate(shares):
            at = (len(held) - 1) * share
            want = (held[math.floor(at)], held[math.ceil(at)]) if held else (None, None)
            assert (r[f"low_{i}"], r[f"high_{i}"]) == want
    assert evaluation.order_statistics(df.filter("false"), ["mode"], "ms", shares).count() == 0

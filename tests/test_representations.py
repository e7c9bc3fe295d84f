"""Search by several vectors of a story, and the choice of a representation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import lifecycle, representations, vector


def unit(rng, d=8):
    v = rng.standard_normal(d)
    return (v / np.linalg.norm(v)).tolist()


def test_best_field_in_the_task_equals_best_of_fields(spark, monkeypatch):
    """Missing fields, stories without any, copies, queries without a vector; blocks and slices of a few rows."""
    monkeypatch.setattr(vector, "BLOCK", 3)
    monkeypatch.setattr(vector, "SLICE", 4)
    rng = np.random.default_rng(1)
    rows = [(i, *(unit(rng) if rng.random() < 0.7 else None for _ in range(3))) for i in range(30)] + [(50, None, None, None)]
    rows += [(60 + i, *rows[2][1:]) for i in range(4)]
    stories = spark.createDataFrame(rows, "story_id long, a array<double>, b array<double>, c array<double>").repartition(3)
    queries = spark.createDataFrame([(q, unit(rng) if q != 5 else None) for q in range(8)], "query_id long, vector array<double>")
    out = vector.multi_vector_topk(queries, stories, ["a", "b", "c"], 6)
    fields = stories.select("story_id", F.explode(F.array("a", "b", "c")).alias("v")).filter("v is not null")
    pairs = queries.filter("vector is not null").crossJoin(fields).select("query_id", "story_id", vectors.dot(F.col("vector"), F.col("v")).alias("similarity"))
    best = {(r["query_id"], r["story_id"]): r["similarity"] for r in lifecycle.best_of_fields(pairs).collect()}
    want = []
    for q in (0, 1, 2, 3, 4, 6, 7):
        ranked = sorted(((-round(s, 6), i) for (of, i), s in best.items() if of == q))[:6]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(ranked)]
    got = sorted((r["query_id"], r["story_id"], round(r["similarity"], 6), r["rank"]) for r in out.collect())
    assert got == sorted(want)


def test_hashed_vectors(spark):
    texts = spark.createDataFrame([(1, "Same words same"), (2, "same WORDS same"), (3, "..."), (4, ""), (5, None), (6, "other")], "id long, text string")
    made = {r["id"]: r["vector"] for r in representations.hashed_vectors(texts, ["id"], 32).collect()}
    assert set(made) == {1, 2, 6} and made[1] == made[2] and len(made[6]) == 32
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in made.values())


def test_the_preferred_mode_may_lose_two_points(spark):
    for default, selected in ((0.48, "default"), (0.47, "legacy"), (0.9, "default")):
        rows = [("legacy", None, 0.5), ("default", None, default), ("default", "exact", 0.0), ("multi_vector", None, 1.0)]
        out = representations.select_mode(spark.createDataFrame(rows, "mode string, variant string, recall_3 double")).collect()
        assert {r["mode"] for r in out if r["selected"]} == {selected}


def test_ablation_tells_fields_apart(spark):
    """A word that is in the title alone is found by several vectors; queries without terms are left out."""
    rows = []
    for i in range(12):
        parts = {"title": f"word{i}", "abstract": f"word{i + 1} note", "content": " ".join(f"filler{j}" for j in range(30))}
        rows += [(i, f"multi_vector:{f}", t) for f, t in parts.items()]
        rows += [(i, "legacy", parts["content"]), (i, "full", " ".join(parts.values())), (i, "default", f"{parts['title']} {parts['abstract']}")]
    embedded = representations.hashed_vectors(spark.createDataFrame(rows, "story_id long, representation string, text string"), ["story_id", "representation"], 512)
    asked = spark.createDataFrame([(i, "exact" if i < 6 else "masked", f"word{i}") for i in range(12)] + [(99, "exact", "...")], "query_id long, variant string, text string")
    queries = asked.select("query_id", "variant").join(representations.hashed_vectors(asked, ["query_id"], 512), "query_id", "left")
    qrels = asked.select("query_id", F.least("query_id", F.lit(11)).alias("story_id"))
    out = {(r["mode"], r["variant"]): r for r in representations.representation_ablation(queries, qrels, embedded).collect()}
    assert len(out) == 12 and out["multi_vector", None]["recall_3"] == 1.0 and out["multi_vector", "masked"]["n"] == 6
    assert out["multi_vector", None]["right_similarity"] == 1.0 and out["multi_vector", None]["vectors_per_story"] == 3
    assert out["legacy", None]["recall_3"] < 0.5 < out["default", None]["recall_3"] and out["default", None]["n"] == 12
    assert {m for (m, _), r in out.items() if r["selected"]} == {"default"}

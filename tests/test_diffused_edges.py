"""What the registered diffusion queries hand to the operator."""

from __future__ import annotations

from engram.params import DEFAULTS
from engram.plans import iterative_queries, views

DATA = "/root/testdata/sf0.001"


def test_diffusion_queries_see_every_edge_type(spark, monkeypatch):
    given = {}
    hits = spark.createDataFrame([(1, 1, 1, 0.9, 0.9)], "query_id long, story_id long, rank int, vector_similarity double, similarity double")
    monkeypatch.setattr(iterative_queries.R, "hybrid", lambda spark, sf_dir: hits)
    monkeypatch.setattr(iterative_queries.diffusion, "diffuse", lambda seeds, edges, active, params: given.update(edges=edges, params=params))
    iterative_queries._diffused(spark, DATA)
    types = lambda edges: {r[0]: r[1] for r in edges.groupBy("edge_type").count().collect()}
    assert types(given["edges"]) == types(views.frame(spark, DATA, "edges"))
    assert "temporal" in types(given["edges"]) and given["params"] == DEFAULTS

"""A task of vector search holds tiles of scores, not a block of queries by a slice of stories."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from engram.operators import vector


def test_memory_of_a_vector_task(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, job, schema: taken.append(job) or spark.createDataFrame([], schema))
    queries = spark.range(4096).selectExpr("id AS query_id", "array(cast(id AS double), 1.0D) AS vector")
    vector.vector_topk(queries, spark.range(1).selectExpr("id AS story_id", "array(1.0D, 0.0D) AS embedding"), 3)
    vectors = np.random.default_rng(0).normal(size=(2048, 2))
    batch = pa.record_batch([pa.array(range(2048)), pa.array(vectors.tolist()), pa.array([0] * 2048)], names=["story_id", "embedding", "scope"])
    tracemalloc.start()
    try:
        (out,) = taken[0](iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 3 * 4096
    assert peak < 60e6, peak

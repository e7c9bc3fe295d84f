"""Vector expressions work out what they are given once a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import vectors


def test_a_vector_is_read_once_where_it_is_normalised(spark):
    drawn = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * F.rand(3))  # another draw at every reading
    rows = spark.range(50).select(vectors.l2_normalize(drawn).alias("v"))
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in rows.collect())


def test_normalised_as_before(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)], "v array<double>")
    assert [r[0] for r in rows.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None, None]

"""The audit of splits shuffles no text, and says the same of stories with two vectors or with one line as its SQL."""

from __future__ import annotations

import random

import pyarrow as pa

from .test_sql_sides import both


def shuffled(spark):
    """Bytes that each stage so far has written for shuffles."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_no_text_is_shuffled(spark, tmp_path):
    rng = random.Random(1)
    texts = ["\n".join(rng.randbytes(5000).hex() for _ in range(1 + i % 5)) for i in range(60)]
    n = len(texts)
    documents = pa.table({"doc_id": list(range(n)), "text": texts, "lang": ["de"] * n, "source": ["s"] * n, "n_chars": [1] * n})
    embeddings = pa.table({"vec_id": [0, 3, 3, 22], "embedding": pa.array([[1.0, 0.0]] * 4, pa.list_(pa.float32())), "label": [1] * 4})
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = both(spark, tmp_path, "split_audit", {"documents": documents, "embeddings": embeddings})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) == n + 1
    assert sum(b for k, b in shuffled(spark).items() if k not in before) < 100_000 < sum(map(len, texts))

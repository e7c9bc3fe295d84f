"""Queries whose SQL once gave other rows: a session without a conclusion, a letter whose upper case is longer, and titles
whose terms cancel or are of one letter that folds to two."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from engram.operators import lifecycle
from engram.plans import catalogue


def both(spark, folder, name, tables):
    c = duckdb.connect()
    for t, table in tables.items():
        pq.write_table(table, f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr), sorted(want, key=repr)


def test_session_without_a_conclusion(spark, tmp_path):
    rows = {"conv_id": [5, 5, 10], "turn": [0, 1, 0], "role": ["user", "assistant", "user"], "text": ["a", "b", "c"]}
    got, want = both(spark, tmp_path, "session_upsert", {"conversations": pa.table(rows)})
    assert got == want
    assert [r[0] for r in got] == ["unchanged", "updated"]


def test_transform_with_a_long_upper_case(spark, tmp_path):
    documents = pa.table({"doc_id": [10, 11], "text": ["x geätz ßa b c", "y"], "lang": ["de", "de"], "source": ["s", "s"], "n_chars": [14, 1]})
    embeddings = pa.table({"vec_id": [10, 11], "embedding": pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), "label": [1, 1]})
    got, want = both(spark, tmp_path, "transform_join", {"documents": documents, "embeddings": embeddings})
    assert got == want == [("GEÄTZ SSA B", 10)]


def test_reembedding_of_awkward_titles(spark, tmp_path):
    titles = ["Die tz.", "Eredth Ered", "of es", "ß ß", "ẞ", "中文", "...", "", None, "plain words", "die die"]
    ids = [19 * i for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12)]  # none has a shadow row, is deleted or goes without a title
    documents = pa.table({"doc_id": ids, "text": pa.array(titles, pa.string()), "lang": ["de"] * len(ids), "source": ["s"] * len(ids), "n_chars": [1] * len(ids)})
    embeddings = pa.table({"vec_id": [1], "embedding": pa.array([[1.0, 0.0]], pa.list_(pa.float32())), "label": [1]})
    got, want = both(spark, tmp_path, "reembed_status", {"documents": documents, "embeddings": embeddings})
    assert got == want
    title = dict(zip(ids, titles, strict=True))
    assert {title[r[3]] for r in got if r[2] == "failed"} == {"...", "", None} and len(got) == len(ids)


def test_a_vector_is_what_it_was_unless_its_terms_cancel(spark):
    terms = spark.createDataFrame([(["die", "tz"],), (["plain", "words"],), ([],), (None,)], "terms array<string>")
    rows = [r[0] for r in terms.select(lifecycle.hashing_vector(F.col("terms"), 64)).collect()]
    assert rows[2] is None and rows[3] is None
    assert sorted(x for x in rows[0] if x) == [1.0]  # both terms at one place, with opposite signs
    at = terms.select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(64)) for t in ("plain", "words"))).first()
    assert [i for i, x in enumerate(rows[1]) if x] == sorted(at) and all(abs(x * x - 0.5) < 1e-12 for x in rows[1] if x)

"""Queries as they are registered."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from engram.llm import entry


def test_substring_dedup_query_doubles_on(spark, tmp_path):
    word = [f"w{i}" for i in range(1200)]
    rows = [
        (1, " ".join(word[:600])), (2, "  ".join(word[:600])),  # copies: 35 * 16 = 560
        (3, " ".join(["a", *word[700:850], "b"])), (4, " ".join(["c", *word[690:840], "d"])),  # 140 words shared: 140
        (5, " ".join(["e", *word[900:969]])), (6, " ".join(["f", *word[900:970]])),  # 69 words shared: 35
        (7, " ".join([*word[1000:1100], "g", *word[1010:1090]])),  # 80 words within one document: 70
        (8, " ".join(word[100:300])),  # part of the copies: 140
        (9, " ".join(word[1100:1200])), (None, " ".join([*word[970:990], *word[:90]])), (10, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op1_substring_dedup"](spark, str(tmp_path))
    assert {r["doc_id"]: r["longest"] for r in out.collect()} == {1: 560, 2: 560, 3: 140, 4: 140, 5: 35, 6: 35, 7: 70, 8: 140, 9: 0, None: 70, 10: 0}


def test_near_dedup_stage_keeps_one_row_of_each_component(spark, tmp_path):
    say = lambda n: " ".join(f"{a}{n}{b}" for a in "abdgkmprst" for b in "eioua")
    rows = [
        (1, say(1)), (None, say(1)), (None, say(1).upper()),  # copies without an id
        (None, say(2)), (None, say(3)), (None, say(3)),  # different texts without an id
        (5, say(4)), (5, say(5)), (6, say(5)),  # one id, two components
        (7, say(6)), (7, say(6)), (8, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, say(1)), (None, say(2)), (None, say(3)), (5, say(4)), (5, say(5)), (7, say(6)), (8, None)])

"""What several variants share is searched once; patterns and terms in many texts against plain containment."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions import runs
from engram.functions import text as T
from engram.operators import delivery, fusion, lexical


@pytest.mark.parametrize("together", [1, 7, 1 << 17])
def test_patterns_like_plain_containment(monkeypatch, together):
    monkeypatch.setattr(runs, "_TOGETHER", together)
    rng = random.Random(together)
    for letters in ["ab", "ab ", "abc é漢,"] * 40:
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 40]))) for _ in range(rng.randrange(8))]
        patterns = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 20]))) for _ in range(rng.randrange(30))}
        patterns = sorted(patterns | {t[i : i + 20] for t in texts if t for i in (0, 3) if t[i:]})
        found, text = runs.Patterns([p.encode() for p in patterns]).find(*runs.parts(pa.array(texts, pa.string())))
        assert list(zip(text.tolist(), found.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t and p in t]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_terms_within_runs_like_plain_containment(monkeypatch, size):
    """Terms of many lengths within longer runs, ideographs, wholes with marks, and wholes that are a term."""
    monkeypatch.setattr(lexical, "SLICE", size)
    monkeypatch.setattr(lexical, "PIECE", 17)
    monkeypatch.setattr(lexical, "SHORT", 3)
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abc_1", k=rng.choice([1, 2, 3, 4, 8, 9, 17]))) + rng.choice(["", "", ",", "***"])
    words = [word() for _ in range(60)] + ["漢字", "漢字仮名", "é", "字"]
    said = lambda n: rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randrange(n)))
    stories = [(i, *(said(n) for n in (3, 6, 20, 3))) for i in range(50)]
    asked = []
    for q in range(120):
        exact = said(4).strip() or "ab"
        if terms := re.findall(T.TERM, exact):
            asked.append({"query_id": q, "exact": exact, "terms": list(dict.fromkeys(terms))})
    batches = [pa.record_batch([pa.array([r[c] for r in part]) for c in range(5)], names=["story_id", *lexical.FIELDS]) for part in (stories[:30], stories[30:])]
    out = pa.Table.from_batches(list(lexical._best_of_slices(lexical._Block.of(asked), 7, iter(batches)))).to_pylist()
    want = []
    for q in asked:
        scored = []
        for i, *fields in stories:
            worth = lambda p, table: sum(w for f, w in zip(fields, table, strict=True) if p in f)  # noqa: E731, B023
            if score := sum(worth(t, lexical.TERM_WORTH) for t in q["terms"]):
                scored.append((-(score + worth(q["exact"], lexical.EXACT_WORTH)), i))
        want += [(q["query_id"], i, -s) for s, i in sorted(scored)[:7]]
    assert [(r["query_id"], r["story_id"], r["score"]) for r in out] == want and len({t for q in asked for t in q["terms"]}) > 40


def test_variants_that_share_a_vector_or_words_are_searched_once(spark, monkeypatch):
    asked = {"vector": [], "lexical": []}
    lane, of = fusion.vector_lane, lexical._Block.of
    monkeypatch.setattr(fusion, "vector_lane", lambda queries, *rest: asked["vector"].append(queries.count()) or lane(queries, *rest))
    monkeypatch.setattr(lexical._Block, "of", staticmethod(lambda rows: asked["lexical"].append(len(rows)) or of(rows)))
    s = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.8, 0.6], f"word{i} same") for i in range(6)], "story_id long, embedding array<double>, content string").withColumns({f: F.lit("") for f in ("title", "abstract", "keywords")})
    q = spark.createDataFrame([(1, "word1 same", [1.0, 0.0]), (2, "word2 same", [0.8, 0.6]), (3, "same", [0.0, -1.0])], "query_id long, text string, vector array<double>")
    variants = q.select("query_id", "vector", F.posexplode(F.array(F.lit("same"), F.element_at(F.split("text", " "), 1))).alias("i", "text")).select("query_id", (F.col("i") + 1).alias("query_index"), "text", "vector")
    out = delivery.expanded_recall(q, variants, s, 3, 5).collect()
    assert asked == {"vector": [3], "lexical": [5]}
    best = {r["query_id"]: r["story_id"] for r in out if r["rank"] == 1}
    assert best[1] == 1 and best[2] == 2 and sorted(r["query_id"] for r in out) == [1] * 3 + [2] * 3 + [3] * 3

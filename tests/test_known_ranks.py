"""Places of known stories by counting, against plain sorting; and texts whose terms are counted where they are read."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from engram.functions import runs
from engram.functions import text as T
from engram.operators import representations, stories, vector


@pytest.mark.parametrize("k", [1, 4, 50])
def test_ranks_like_plain_sorting(spark, monkeypatch, k):
    """Counts of a few terms give many ties; some fields are missing, some vectors and pairs come twice."""
    monkeypatch.setattr(vector, "BLOCK", 7)
    monkeypatch.setattr(vector, "SLICE", 5)
    monkeypatch.setattr(vector, "ROWS", 3)
    rng = np.random.default_rng(k)
    counts = lambda: [int(x) for x in rng.integers(-1, 2, 6)]
    held = [(i, *(c if rng.random() < 0.7 and any(c := counts()) else None for _ in range(2))) for i in range(60)]
    asked = [q for q in (np.array(counts(), float) for _ in range(30)) if q.any()]
    asked = [q / np.linalg.norm(q) for q in asked + asked[:9]]
    score = lambda q, s: max((round(float(q @ np.array(f) / np.linalg.norm(f)), 6) for f in s[1:] if f), default=None)
    pairs, want = [], []
    for n, q in enumerate(asked):
        order = sorted((-v, s[0]) for s in held if (v := score(q, s)) is not None)
        for story in {int(x) for x in rng.integers(0, 60, 3)}:
            own = score(q, held[story])
            pairs.append((n, story, q.tolist(), own))
            if own is not None and (rank := order.index((-own, story)) + 1) <= k:
                want.append((n, story, rank))
    df = spark.createDataFrame(pairs, "query_id long, story_id long, vector array<double>, similarity double")
    got = vector.known_ranks(df, spark.createDataFrame(held, "story_id long, a array<int>, b array<int>").repartition(3), ["a", "b"], k).collect()
    assert sorted((r["query_id"], r["story_id"], r["rank"]) for r in got) == sorted(want) and want


def test_a_story_that_k_others_precede_is_asked_for_no_more():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(4000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ahead = vector._Ahead(vectors[:100], np.full(100, 9000), np.array([1000000] + [-1000000] * 99), 50, 6)
    ahead.count(np.arange(500), [(np.ones(500, bool), vectors[:500])])
    assert ahead.open.tolist() == [0] and (ahead.n[1:] >= 50).all()


def test_terms_are_counted_where_texts_are_read(spark):
    """The vectors of hashed_vectors, from one reading of each field: nothing is exploded or shuffled."""
    rng = random.Random(3)
    said = lambda n: "".join(rng.choices("ab_Z9ß .,\n漢字é", k=n))
    rows = [(i, rng.choice([None, "", " ", said(9)]), said(rng.choice([0, 40])), rng.choice([None, said(300)]), rng.choice([["en", "src"], ["x", None], []])) for i in range(60)]
    s = spark.createDataFrame(rows, "story_id long, title string, abstract string, content string, keywords array<string>")
    made = representations.counted_texts(s)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r["story_id"], c): r[c] for r in made.collect() for c in representations.COLUMNS if r[c]}
    want = {(r["story_id"], r["representation"].removeprefix("multi_vector:")): r["vector"] for r in representations.hashed_vectors(stories.embedding_texts(s), ["story_id", "representation"]).collect()}
    assert set(got) == set(want) and len(want) > 200
    assert all((np.array(got[key]) / np.linalg.norm(got[key]) == want[key]).all() for key in want)


def test_runs_like_the_pattern(spark):
    rng = random.Random(1)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("ab_1 .,-é漢字㐀䶿鿿가かß\n𠀀x。", k=rng.choice([0, 1, 3, 30]))) for _ in range(rng.randrange(8))]
        terms, code, owner = runs.runs(pa.array(["zz", *texts, "q"], pa.string()).slice(1, len(texts)))
        got = [[terms[c].decode() for c, o in zip(code, owner, strict=True) if o == i] for i in range(len(texts))]
        assert got == [re.findall(T.TERM, t or "") for t in texts] and len(set(terms)) == len(terms)


def test_pieces_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 10)
    texts = ["", "x" * 25, None, "abc", "abc", "abcdefgh", "", ""]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    parts = list(runs.pieces(batch, 1, 3))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8)) and all(0 < p.num_rows <= 3 for p in parts) and len(parts) == 3

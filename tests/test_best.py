"""The k best of tiles against plain sorting, BM25 of a task against its formula, and the memory of a task."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from engram.operators import best, lexical


@pytest.mark.parametrize(("kind", "digits"), [("float", 1), ("float", 12), ("whole", 0)])
def test_best_like_plain_sorting(monkeypatch, kind, digits):
    monkeypatch.setattr(best, "WAITING", 30)
    rng = np.random.default_rng(digits)
    n, k, ids = 7, 4, rng.permutation(90)
    scores = rng.integers(0, 6, (n, 90)).astype(np.uint16) if kind == "whole" else np.where(rng.random((n, 90)) < 0.2, -np.inf, rng.normal(size=(n, 90)))
    least = 1 if kind == "whole" else np.finfo(float).min
    top = best.Best(n, k, digits, least)
    for at in range(0, 90, 13):
        for q in (0, 4):
            top.offer(q, scores[q : q + 4, at : at + 13], ids[at : at + 13])
    got = [tuple(r.values()) for r in top.rows(np.arange(100, 100 + n)).to_pylist()]
    want = [(100 + q, i, -s) for q in range(n) for s, i in sorted((-float(np.round(float(s), digits)), int(i)) for s, i in zip(scores[q], ids, strict=True) if s >= least)[:k]]
    assert got == want


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_bm25_of_a_task_like_its_formula(monkeypatch, size):
    monkeypatch.setattr(lexical, "SLICE", size)
    rng = random.Random(size)
    words = ["ab", "abc", "b-c", "cd,", "d", "zz"]
    stories = [(i, *(" ".join(rng.choices(words, k=rng.randrange(5))) for _ in lexical.FIELDS)) for i in range(40)]
    asked = [{"query_id": 10 * q, "exact": "", "terms": t} for q, t in enumerate([["ab"], ["d", "b"], ["cd", "zz", "abc"], ["ab"]])]
    block = lexical._Block.of(asked)
    idf = {t: 1 + n / 7 for n, t in enumerate(block.terms)}
    batches = [pa.record_batch([pa.array([r[c] for r in part]) for c in range(5)], names=["story_id", *lexical.FIELDS]) for part in (stories[:17], stories[17:])]
    out = pa.Table.from_batches(list(lexical._best_by_bm25(block, np.array(list(idf.values())), 9.0, 5, 1.2, 0.75, iter(batches)))).to_pylist()
    want = []
    for q in asked:
        scored = []
        for i, *fields in stories:
            tokens = [re.findall("[a-z0-9_]+", f) for f in fields]
            tf, length = Counter(), sum(map(len, tokens))
            for w, own in zip(lexical.BM25_WEIGHT, tokens, strict=True):
                for t in own:
                    tf[t] += w
            if any(tf[t] for t in q["terms"]):
                scored.append((-round(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * length / 9)) for t in q["terms"]), 6), i))
        want += [(q["query_id"], i, -s) for s, i in sorted(scored)[:5]]
    assert [(r["query_id"], r["story_id"]) for r in out] == [w[:2] for w in want]
    assert all(math.isclose(r["bm25"], w[2], abs_tol=1e-6) for r, w in zip(out, want, strict=True))


def test_memory_of_a_lexical_task():
    """4,096 queries and 2,048 stories, whose scores at once are 64 MB."""
    asked = [{"query_id": q, "exact": "", "terms": [f"w{q % 600}", f"v{q // 600}"]} for q in range(4096)]
    texts = [f"w{i % 600} v{i % 7}" for i in range(2048)]
    batch = pa.record_batch([pa.array(range(2048)), *[pa.array(texts)] * 4], names=["story_id", *lexical.FIELDS])
    tracemalloc.start()
    try:
        out = list(lexical._best_of_slices(lexical._Block.of(asked), 5, iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out[0].num_rows == 5 * 4096
    assert peak < 60e6

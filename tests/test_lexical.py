"""The best stories of a task by their terms, against plain containment, in slices and batches of a few rows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from engram.operators import lexical


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_best_of_slices_like_plain_containment(monkeypatch, size):
    monkeypatch.setattr(lexical, "SLICE", size)
    rng = random.Random(size)
    words = ["ab", "abc", "b c", "cd", "d", "é", "zz", "quite rare"]
    stories = [(i, *(" ".join(rng.choices(words, k=rng.randrange(4))) for _ in lexical.FIELDS)) for i in range(40)]
    stories += [(100 + i, *stories[3][1:]) for i in range(3)]
    asked = [{"query_id": q, "exact": " ".join(t), "terms": t} for q, t in enumerate([["ab"], ["ab", "d"], ["cd", "zz", "é"], ["missing"], ["quite", "rare"], ["b"]])]
    batches = [pa.record_batch([pa.array([r[c] for r in part]) for c in range(5)], names=["story_id", *lexical.FIELDS]) for part in (stories[:17], stories[17:])]
    out = pa.Table.from_batches(list(lexical._best_of_slices(lexical._Block.of(asked), 5, iter(batches)))).to_pylist()
    want = []
    for q in asked:
        scored = []
        for i, *fields in stories:
            worth = lambda p, table: sum(w for f, w in zip(fields, table, strict=True) if p in f)  # noqa: E731, B023
            if any(t in f for t in q["terms"] for f in fields):
                scored.append((-(sum(worth(t, lexical.TERM_WORTH) for t in q["terms"]) + worth(q["exact"], lexical.EXACT_WORTH)), i))
        want += [(q["query_id"], i, -s) for s, i in sorted(scored)[:5]]
    assert [(r["query_id"], r["story_id"], r["score"]) for r in out] == want


def test_no_queries_and_no_stories():
    block = lexical._Block.of([])
    assert [b.num_rows for b in lexical._best_of_slices(block, 5, iter([]))] == [0]
    block = lexical._Block.of([{"query_id": 1, "exact": "a", "terms": ["a"]}])
    assert [b.num_rows for b in lexical._best_of_slices(block, 5, iter([]))] == [0]

"""Budgeted diffusion against a walk that takes one step after another."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest

from engram.operators import diffusion
from engram.params import DEFAULTS, Params

DIRECTED = {"temporal", "causal", "parent_child", "supersedes"}


def walk(seeds, edges, stories, p: Params):
    """query -> {story: (score, tokens)}, written from the rules, one path at a time."""
    active = {i: a for i, a in stories}
    around: dict[int, list] = {}
    for eid, s, t, kind, w, deleted in edges:
        if deleted:
            continue
        d = kind in DIRECTED
        around.setdefault(s, []).append((t, eid, kind, w, "outbound" if d else "undirected"))
        around.setdefault(t, []).append((s, eid, kind, w, "inbound" if d else "undirected"))
    gone = {t for eid, s, t, kind, w, deleted in edges if kind == "supersedes" and not deleted and s in active}
    out = {}
    for query in sorted({q for q, _, _ in seeds}):
        own = sorted([(s, sim) for q, s, sim in seeds if q == query], key=lambda x: (-x[1], x[0]))
        names = {s for s, _ in own}
        front = [(sim, s, s, sim, 1.0, 1.0, [], [s]) for s, sim in own]
        best, kept, paths, tokens, stop = {}, {}, 0, 0, False
        for hop in range(1, p.hops + 1):
            new = []
            for state in front:
                if stop:
                    break
                _, seed, node, base, product, hubs, kinds, visited = state
                options = []
                for nb, eid, kind, w, direction in around.get(node, []):
                    passable = direction == "undirected" or kind == "parent_child" or (kind == "supersedes" and direction == "inbound") or (kind in ("temporal", "causal") and direction == "outbound")
                    if not passable or nb not in active:
                        continue
                    if kind in ("co_recall", "sibling") and hop > 1 or {"co_recall", "sibling"} & set(kinds) or kind in ("same_environment", "supersedes") and kind in kinds:
                        continue
                    options.append((-w, eid, nb, kind, direction, w))
                for _, eid, nb, kind, direction, w in sorted(options)[: p.fan_out]:
                    if nb in visited:
                        continue
                    if paths >= p.paths:
                        stop = True
                        break
                    paths += 1
                    pr = product * (min(1, max(0, w)) * p.type_factor[kind] * (0.9 if kind == "parent_child" and direction == "inbound" else 1.0))
                    hb = hubs * (1.0 / math.sqrt(max(1.0, len(around[nb]) / p.fan_out)))
                    score = base * pr * hb * p.hop_decay ** (hop - 1)
                    if score < p.least_score or (seed, nb) in best and score <= best[seed, nb]:
                        continue
                    if nb not in names and (nb not in kept or round(score, 8) > kept[nb][0]):
                        cost = max(1, math.ceil(len(active[nb]) / 4) + 80 * hop)
                        delta = cost - (kept[nb][1] if nb in kept else 0)
                        if tokens + delta > p.tokens:
                            stop = True
                            break
                        tokens += delta
                        kept[nb] = (round(score, 8), cost)
                    best[seed, nb] = score
                    new.append((score, seed, nb, base, pr, hb, [*kinds, kind], [*visited, nb]))
            front = sorted(new, key=lambda x: -x[0])
            if stop:
                break
        out[query] = {k: v for k, v in kept.items() if k not in gone}
    return out


def table(spark, edges, stories, seeds):
    return (
        spark.createDataFrame(seeds, "query_id long, story_id long, similarity double"),
        spark.createDataFrame(edges, "edge_id long, source_id long, target_id long, edge_type string, weight double, deleted boolean"),
        spark.createDataFrame(stories, "story_id long, abstract string"),
    )


@pytest.mark.parametrize("case", range(4))
def test_like_a_sequential_walk(spark, case):
    rng = random.Random(case)
    kinds = list(DEFAULTS.type_factor)
    edges = []
    for eid in range(90):
        a, b = rng.sample(range(24), 2)
        edges.append((eid, a, b, rng.choice(kinds), rng.choice([0.7, 0.85, 0.93, 1.0, 0.99]), rng.random() < 0.1))
    stories = [(i, "x" * rng.randrange(0, 400)) for i in range(24) if i % 7]
    seeds = [(q, s, sim) for q in range(3) for s, sim in zip(rng.sample([i for i, _ in stories], 3), (0.99, 0.95, 0.9), strict=True)]
    p = [replace(DEFAULTS, least_score=0.3, hops=3), replace(DEFAULTS, least_score=0.2, paths=15, fan_out=3), replace(DEFAULTS, least_score=0.1, tokens=500), replace(DEFAULTS, least_score=0.2, hops=2, fan_out=2)][case]
    rows = diffusion.diffuse(*table(spark, edges, stories, seeds), p).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["story_id"]] = (round(r["score"], 7), r["tokens"])
        assert len(r["path"]) == r["hop"] <= p.hops
        assert len({s["node"] for s in r["path"]}) == len(r["path"])
    want = {q: {k: (round(s, 7), t) for k, (s, t) in v.items()} for q, v in walk(seeds, edges, stories, p).items()}
    assert got == {q: v for q, v in want.items() if v}


def test_merge_prefers_direct_on_ties(spark):
    direct = spark.createDataFrame([(1, 5, 0.8, 0.8)], "query_id long, story_id long, fusion double, similarity double")
    found = spark.createDataFrame([(1, 5, 0.8), (1, 6, 0.9)], "query_id long, story_id long, score double")
    assert [(r["story_id"], r["lane"]) for r in diffusion.merge(direct, found, 5).orderBy("rank").collect()] == [(6, "graph"), (5, "direct")]

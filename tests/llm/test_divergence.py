"""Source divergence against a plain version and against the query's SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import divergence, entry

from .conftest import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top=50):
    """lang, source, part, item, value, rank of rows of lang, source and text."""
    rows = [tuple(x or "" for x in row) for row in rows]
    docs, count = Counter(), defaultdict(Counter)
    groups = defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= min_docs]
        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            over = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs", [1, 2, 4, 30])
def test_awkward_rows(spark, docs, min_docs):
    """Nulls, copies, very long texts and chunks, columns with clashing names."""
    clash = docs.withColumn("chunk", F.lit(1)).withColumn("term", F.lit("x")).withColumn("n", F.lit(None))
    want = plain([(r["lang"], r["source"], r["text"]) for r in docs.collect()], min_docs)
    assert rows_of(divergence.source_divergence(clash, min_docs)) == want


@pytest.fixture(scope="module")
def mixed():
    """Terms that are in enough documents only by several of their chunks, and one word that is in all documents."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé日ß") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    dress = [str, str.upper, str.title, lambda w: w + ",", lambda w: f"({w})", lambda w: f"{w}-{w}", lambda w: f"{w}.the{w}"]
    rows = []
    for i in range(300):
        text = " ".join(["The", *(rng.choice(dress)(w) for w in rng.sample(words, rng.randrange(0, 40)))])
        rows.append((rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "ç", None]), text))
    return rows + [("de", "lone", "one"), ("it", "x", "..."), ("it", "y", None), ("it", "z", ""), *[("en", "hot", "same text The")] * 60]


def test_rare_terms_are_counted_by_documents(spark, mixed, monkeypatch):
    """Also with small tiles and blocks, and with few common chunks passed over."""
    df = spark.createDataFrame(mixed, "lang string, source string, text string").repartition(6)
    want = plain(mixed, 30)
    assert rows_of(divergence.source_divergence(df)) == want
    assert rows_of(divergence.source_divergence(df, top=3)) == plain(mixed, 30, 3)
    monkeypatch.setattr(divergence, "_BLOCK", 50)
    monkeypatch.setattr(divergence, "_TILE", 2)
    monkeypatch.setattr(divergence, "_COMMON", 3)
    monkeypatch.setattr(divergence, "_SENT", 1)
    monkeypatch.setattr(divergence, "_MOST_BITS", 256)
    assert rows_of(divergence.source_divergence(df)) == want


def test_query_and_sql(spark, mixed, tmp_path):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(mixed)], "doc_id long, lang string, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = c.sql(entry.oracle_sql()["op11_chunk_divergence"]).fetchall()
    assert sorted(got) == plain(mixed, 30) == rows_of(entry.queries()["op11_chunk_divergence"](spark, str(tmp_path)))


def test_chunks_are_tokenised_once(spark):
    docs = spark.createDataFrame([("en", "s", "a,b a,b A,c"), ("en", "t", "a,b\x0bx-X"), ("fr", "s", "a,b"), ("fr", "s", "")], "lang string, source string, text string")
    out = {r["chunk"]: (r["terms"], sorted(map(tuple, r["langs"]))) for r in divergence.chunk_terms(docs.repartition(3)).collect()}
    assert out == {"A,c": (["a", "c"], [("en", 1)]), "a,b": (["a", "b"], [("en", 2), ("fr", 1)]), "x-X": (["x", "x"], [("en", 1)])}


def test_a_task_adds_up_its_slices(mixed, monkeypatch):
    """In this process, where slices and what is held can be made small."""
    monkeypatch.setattr(divergence, "_SLICE", 300)
    want = Counter((lang or "", c) for lang, _, text in mixed for c in set((text or "").split()))
    for held in (1, 50, 1 << 21):
        monkeypatch.setattr(divergence, "_HELD", held)
        batches = [pa.record_batch({"lang": [r[0] or "" for r in part], "text": [r[2] for r in part]}) for part in (mixed[:100], mixed[100:])]
        got, n = Counter(), 0
        for batch in divergence._documents_of_chunks(iter(batches)):
            for row in batch.to_pylist():
                got[row["lang"], row["chunk"]] += row["docs"]
                n += 1
        assert got == want and (n == len(want)) == (held == 1 << 21)


def test_the_map_of_wanted_chunks_forgets_none(spark, monkeypatch):
    words = [f"w{i}é" for i in range(5000)]
    chunks = spark.createDataFrame([(w,) for w in words], "chunk string").repartition(4)
    for most in (1 << 28, 1 << 10):
        monkeypatch.setattr(divergence, "_MOST_BITS", most)
        held = divergence.ChunkMap(chunks)
        assert held.may_hold(divergence._hashes(pa.array(words))).all()
        others = held.may_hold(divergence._hashes(pa.array([f"x{i}" for i in range(5000)]))).mean()
        assert others < 0.06 if most > 1 << 20 else others > 0.9
    assert not divergence.ChunkMap(chunks.limit(0)).may_hold(divergence._hashes(pa.array(words))).any()


def test_counts_beyond_a_long_stay_exact(spark):
    n, total = 3 * 10**12, 7 * 10**12
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(11)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 55)


def test_an_empty_table(spark, empty):
    assert divergence.source_divergence(empty).count() == 0



def test_a_task_sends_counts_of_terms(mixed, monkeypatch):
    """In this process: no row a document or chunk, whatever the slices; documents are counted in rare chunks only."""
    taken = []

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, work, schema: taken.append(work)  # noqa: E731, N815

    class All:
        may_hold = staticmethod(lambda hashes: np.ones(len(hashes), bool))

    monkeypatch.setattr(divergence, "_SLICE", 300)
    divergence._counted_again(Docs(), All, All, ["The"])
    n, docs = Counter(), Counter()
    for lang, source, text in mixed:
        found = TERM.findall((text or "").translate(LOWER))
        n.update((lang or "", source or "", t) for t in found)
        rare = {t for c in (text or "").split() if c != "The" for t in TERM.findall(c.translate(LOWER))}
        docs.update((lang or "", source or "", t) for t in rare)
    batches = [pa.record_batch({"lang": [r[0] or "" for r in part], "source": [r[1] or "" for r in part], "text": [r[2] for r in part]}) for part in (mixed[:100], mixed[100:])]
    got = [r for b in taken[0](iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(n) and Counter({(r["lang"], r["source"], r["term"]): r["n"] for r in got}) == n
    assert Counter({(r["lang"], r["source"], r["term"]): r["docs"] for r in got if r["docs"]}) == docs

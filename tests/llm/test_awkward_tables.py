"""Operators on rows with nulls, copies, very long texts and columns with clashing names, and on no rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from engram.llm import langid, packing, secret_scan, simhash_trie, toxicity

LONG = 400_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("tor", "men", "vil", "ß") for b in "aeiou" for c in ("n", "st", "re")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_one = " ".join(f"{say(1)}{i}" for i in range(LONG // 8)) + " password = hunter2222 " + "0af" * 10
    out = [(None, None), (None, "idiot " + say(30)), (None, "idiot " + say(30)), (1, ""), (2, " \n"), (3, long_one), (4, "x" * LONG), (5, long_one + " end")]
    return out + [(6, say(60))] * 3 + [(7, say(60)), (7, say(60))]


@pytest.fixture(scope="module")
def table(spark, rows):
    """Names that the operators use themselves, and one with a mark in it."""
    df = spark.createDataFrame([(i, t, "en" if n % 2 else None) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for name in ("row", "tkey", "rest", "fp", "score", "piece", "length", "base", "all", "task", "label", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def by_text(df, rows, columns):
    """What each row gives, whatever its order, checked to be the same for equal rows."""
    got = sorted((repr(tuple(r[c] for c in columns)) for r in df.collect()))
    assert len(got) == len(rows)
    return got


def test_secret_scan(table, rows):
    out = secret_scan.secret_scan_digest(table).collect()
    assert len(out) == len(rows)
    for i, t in rows:
        spans = sorted([(m.start(), 0, m.end(), "assign") for m in re.finditer(r"password = [A-Za-z0-9]+", t or "")] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert any(r["doc_id"] == i and (r["n_assign"], r["n_hex"]) == (sum(s[1] == 0 for s in spans), sum(s[1] == 2 for s in spans)) and r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() for r in out)


def test_near_dedup(table, rows):
    out = simhash_trie.near_dedup(table)
    got = by_text(out, rows, ["doc_id", "fingerprint", "component_id"])
    long_ones = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out.filter("doc_id in (3, 5)").collect()}
    assert long_ones[5][1] == 3 and len([g for g in got if g.startswith("(6,")]) == 3 and len({g for g in got if g.startswith("(6,")}) == 1
    assert [r["component_id"] for r in out.filter("doc_id in (1, 2)").collect()] == [1, 1]


def test_language_id(table, rows):
    got = by_text(langid.language_id(table), rows, ["doc_id", "held_out", "lang_pred", "score", "rejected"])
    assert len({g for g in got if g.startswith("(6,")}) == 1 and "'und'" in got[0] + got[1] + got[2] + got[3]
    assert all(r["lang_pred"] == "und" for r in langid.language_id(table.filter("doc_id in (1, 2)")).collect())


def test_toxicity_without_ids(spark, table, rows):
    labels = spark.createDataFrame([(None, 1, 1), (6, 1, 0), (6, 1, 1), (7, 0, 7), (8, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(table, labels)
    got = by_text(out, rows, ["doc_id", "held_out", "score", "predicted"])
    assert len({g for g in got if g.startswith("(6,")}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and (r["doc_id"] is not None or not r["held_out"]) for r in out.collect())
    assert {r["score"] for r in toxicity.toxicity(table, labels.limit(0)).collect()} == {0.5}


def test_packing(table, rows):
    out = packing.best_fit_packing(table)
    tokens = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert tokens[1] == 1 and tokens[5] > 2048 and tokens[4] > 1000
    assert out.filter("doc_id = 6 and piece = 0").count() == 3 and out.filter("length > 2048").count() == 0


def test_no_rows(spark, table):
    none, labels = table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (secret_scan.secret_scan_digest(none), simhash_trie.near_dedup(none), langid.language_id(none), packing.best_fit_packing(none), toxicity.toxicity(none, labels)):
        assert df.count() == 0

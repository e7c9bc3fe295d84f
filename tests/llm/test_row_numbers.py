"""Different texts that a 32-bit hash of the text takes for one stay apart, without an id and under one id."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import decontaminate, line_dedup, substring_dedup

LINE = "a line of more than forty characters that many documents have in common"
PASSAGE = " ".join(f"p{i}" for i in range(60))
ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def clash(spark):
    """Two texts of equal hash: the first holds the shared line, passage and benchmark item, the second is clean."""
    rows = spark.range(400_000)
    dirty = rows.select(F.concat(F.lit(f"{LINE}\n{PASSAGE}\n{ITEM}\nd"), "id").alias("dirty")).select("dirty", F.hash("dirty").alias("h"))
    clean = rows.select(F.concat(F.lit(" ".join(f"u{i}" for i in range(45)) + "\nanother line\nc"), "id").alias("clean")).select("clean", F.hash("clean").alias("h"))
    found = dirty.join(clean.hint("merge"), "h").orderBy("dirty", "clean").first()
    assert found is not None
    return found["dirty"], found["clean"]


@pytest.fixture(params=[None, 7])
def table(request, spark, clash):
    rows = [(i, f"{LINE}\n{PASSAGE}\nown text {i}") for i in range(10, 16)] + [(request.param, t) for t in clash]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(table, clash):
    out = {r["text"]: r["n_dropped"] for r in line_dedup.line_dedup(table).collect()}
    assert out[clash[1]] == 0 and out[clash[0].removeprefix(f"{LINE}\n{PASSAGE}\n")] == 2


def test_substring_dedup(table, clash):
    out = substring_dedup.substring_dedup(table).collect()
    words = clash[1].split()
    assert [(r["n_words"], r["n_removed"], r["longest"]) for r in out if r["kept_sha256"] == sha(" ".join(words))] == [(len(words), 0, 0)]
    assert sorted(r["n_removed"] for r in out)[0] == 0 and sum(r["n_removed"] > 0 for r in out) == 7


def test_a_clean_text_of_few_words(spark, clash):
    """Places found in one text are never read in another, shorter one."""
    rows = [(None, clash[0]), (None, PASSAGE), (None, "few words"), (None, None), (None, "")]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["n_words"], r["n_removed"] > 0) for r in out.collect()) == sorted([(len(clash[0].split()), True), (60, True), (2, False), (0, False), (0, False)])


def test_decontamination(spark, table, clash):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = {r["text"]: (r["n_hit"], r["item_ids"]) for r in decontaminate.decontaminate(table, bench).collect()}
    assert out[clash[0]] == (12, ["1"]) and out[clash[1]] == (0, [])


def test_pipeline_stages(spark, table, clash, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["text"] for r in corpus_pipeline.drop_lines(spark, table, str(tmp_path)).collect()}
    assert clash[1] in kept and clash[0].removeprefix(f"{LINE}\n{PASSAGE}\n") in kept
    clean = {r["text"] for r in corpus_pipeline.drop_contaminated(spark, table, str(tmp_path)).collect()}
    assert clash[1] in clean and clash[0] not in clean


def test_many_copies_without_an_id(spark):
    """Copies are rows of their own, however many there are."""
    rows = spark.range(0, 400, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(PASSAGE).alias("text"))
    out = substring_dedup.substring_dedup(rows).collect()
    assert len(out) == 400 and {r["n_removed"] for r in out} == {60}


def test_a_text_of_many_dropped_lines(spark):
    rows = [(i, "\n".join([LINE, f"own {i}"] * 20_000)) for i in range(6)]
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[5] == (40_000, 0, rows[5][1])
    assert all(out[i] == (40_000, 20_000, "\n".join([f"own {i}"] * 20_000)) for i in range(5))

"""The pipeline against a plain version of its five stages, one after another."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from engram.llm import fertility, vocab

from .conftest import LOWER, WORD, texts
from .test_operators import _plain_components, _plain_prints

pytest.importorskip("public_tokenizers")
BENCH = [(1, "ab cd ef gh ij kl mn op qr st uv"), (2, None)]


def kept(text: str) -> bool:
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(repeat) > 20 * len(w):
        return False
    ids = [i for x in w for i in vocab.byte_bpe(vocab.default_path("byte_bpe_50k.tiktoken")).encode_ordinary(" " + x)]
    sp = vocab.pieces(vocab.default_path("piece_bpe_32k.model"))
    own = [p for x in w for p in sp.encode(x)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    band = fertility.RULES.languages["en"]
    letters = len(re.findall(r"[A-Za-z0-9À-\U0010ffff]", "".join(w)))
    values = (letters / len(ids), sum(map(sp.is_byte, own)) / len(own), -(share * np.log2(share)).sum() / min(np.log2(len(ids)), 8))
    give = fertility.RULES.give / len(ids) ** 0.5
    return all(lo - give <= v <= hi + give for v, (lo, hi) in zip(values, (band.chars_per_token, band.byte_share, band.entropy), strict=True))


def plain(rows):
    rows = [(i, t or "") for i, t in rows if kept(t or "")]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and i != max(h for h in holders[key(line)] if h is not None)
    rows = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]
    root = _plain_components(_plain_prints(rows))
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    seen, stay = set(), []
    for (i, t), r in zip(rows, root, strict=True):
        if i == least.get(r) and i not in seen:
            seen.add(i)
            stay.append((i, t))
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[a : a + 10]) for _, t in BENCH for w in [item.findall((t or "").translate(LOWER))] for a in range(len(w) - 9)}
    clean = [(i, t) for i, t in stay for w in [item.findall(t.translate(LOWER))] if not any(tuple(w[a : a + 10]) in windows for a in range(len(w) - 9))]
    out = Counter()
    for i, t in clean:
        ids = np.array([*vocab.byte_bpe(vocab.default_path("byte_bpe_50k.tiktoken")).encode_ordinary(t), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out[i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def test_pipeline(spark, tmp_path):
    rows = [(i, t) for i, t in texts() if len(t or "") < 20_000]
    tail = " ".join(f"{a}{b}{a}" for a in "abdgkm" for b in "eioua")
    rows += [(70, f"{tail} AB-cd ef gh ij kl mn op qr st uv {tail[::-1]}"), (71, f"{tail} ab cd ef gh {tail[::-1]} ij kl mn")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == plain(rows)
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns, name
    assert 70 not in {r["doc_id"] for r in out} and 71 in {r["doc_id"] for r in out}
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_pipeline_of_an_empty_table_and_of_extra_columns(spark, tmp_path):
    """Columns with marks in their names, or with names that stages use, come through; n_chars needn't be there."""
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"{a}{b}{a}" for a in "abdgkm" for b in "eioua")
    schema = "doc_id long, text string, lang string, `a.b` int, many int, stays string, row int, rest string, tkey int, kept boolean, doc string, `x``y` int"
    rows = [(1, text, "xx", 5, 6, "s", 7, "r", 8, None, "d", 9), (2, text, "xx", 5, 6, "s", 7, "r", 8, False, "d", 9), (3, None, *[None] * 10), (4, text[::-1], None, 1, 2, "t", 3, "q", 4, True, "e", 5)]
    for name, content in (("empty", []), ("extra", rows)):
        docs = spark.createDataFrame(content, schema)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().count() == (2 if content else 0)
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == spark.createDataFrame([], schema).columns, stage_name
        assert sorted(map(tuple, docs.collect())) == ([rows[0], rows[3]] if content else [])

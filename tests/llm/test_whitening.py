"""Whitening against a dense decomposition, and the eigensolver alone on hard spectra."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import entry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def spectrum(name, rng):
    d = 64
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"multiple": np.r_[np.full(30, 5.0), np.ones(34)], "decay": 10.0 ** -np.arange(d), "gap": np.r_[np.full(8, 1e6), np.ones(56)], "tight": 1 + 1e-9 * np.arange(d), "zeros": np.r_[np.arange(1.0, 6.0), np.zeros(59)]}[name]
    a = q * values @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("name", ["multiple", "decay", "gap", "tight", "zeros"])
def test_eigensolver_on_hard_spectra(name):
    a = spectrum(name, np.random.default_rng(2))
    values, vectors = whitening.jacobi_davidson(lambda q: a @ q, 64, 16)
    top = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.abs(values - top).max() <= 64 * 2.3e-16 * top[0]
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 2 * 64 * 2.3e-16 * top[0]
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert (np.diff(values) <= 0).all()


@pytest.mark.parametrize(("dim", "k"), [(1, 1), (2, 1), (5, 5), (17, 16), (300, 16)])
def test_eigensolver_at_odd_sizes(dim, k):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((4 * dim, dim)) * np.arange(1, dim + 1) ** -0.5
    a = x.T @ x / len(x)
    values, vectors = whitening.jacobi_davidson(lambda q: a @ q, dim, k)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:k], rel=1e-11)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 2 * max(64, dim) * 2.3e-16 * values[0]


def test_the_search_space_stays_bounded():
    a = spectrum("decay", np.random.default_rng(4))
    widest = []
    whitening.jacobi_davidson(lambda q: (widest.append(q.shape[1]), a @ q)[1], 64, 8, most=20)
    assert max(widest) <= 20


def plain(rows, dim, components=16):
    """The contract's columns by a dense decomposition, with exact integers; a row per vector."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in good], dtype=np.float64)).astype(np.int64) + 1_000_000
    distinct = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=np.int64)
    n, sums = len(distinct), distinct.astype(object).sum(axis=0)
    y = (distinct - distinct[0]).astype(float)
    y -= y.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    k = min(components, dim, n - 1)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [(sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True))) for r in x.tolist()]
    centred = (x - distinct[0]).astype(float) - (distinct - distinct[0]).astype(float).mean(axis=0)
    return [i for i, _ in good], n, deviation, centred @ vectors / np.sqrt(values), values / (y * y).sum() * n


def check(df, rows, dim, components=16):
    ids, n, deviation, white, explained = plain(rows, dim, components)
    out = df.collect()
    k = white.shape[1]
    assert len(out) == len(ids) * k
    assert {r["n"] for r in out} == {n} and max(r["identity_error"] for r in out) < 1e-9
    assert len({r["identity_error"] for r in out}) == 1
    for c in range(k):
        mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], abs(r["whitened"])) for r in out if r["component"] == c + 1)
        want = sorted((i is None, i or 0, d, abs(w)) for i, d, w in zip(ids, deviation, white[:, c], strict=True))
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert np.array([m[3] for m in mine]) == pytest.approx(np.array([w[3] for w in want]), abs=1e-7)
        shares = {r["explained"] for r in out if r["component"] == c + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(explained[c], rel=1e-9)
        by_row = {(i, d): w for i, d, w in zip(ids, deviation, white[:, c], strict=True)}
        signs = {np.sign(r["whitened"] * by_row[r["vec_id"], r["deviation"]]) for r in out if r["component"] == c + 1 and abs(r["whitened"]) > 1e-3}
        assert len(signs) == 1


def awkward(rng, dim=20):
    scale = np.arange(1, dim + 1) ** -0.7
    rows = [(i, (rng.standard_normal(dim) * scale).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    bad = [None, [], [None] * dim, [*rows[0][1][:-1], None], [*rows[0][1][:-1], float("nan")], [float("inf"), *rows[0][1][1:]], [float("-inf")] * dim, rows[0][1][:-1], [*rows[0][1], 1.0]]
    return rows, [(300 + i, v) for i, v in enumerate(bad)]


def test_awkward_rows(spark):
    rows, bad = awkward(np.random.default_rng(8))
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).withColumn("block", F.lit("x")).withColumn("component", F.lit(7)).repartition(5)
    stored = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    out = whitening.embedding_whitening(table)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, stored, 20)
    check(whitening.embedding_whitening(table, 3), stored, 20, 3)


@pytest.mark.parametrize("n", [2, 3, 10])
def test_fewer_vectors_than_components(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(20).tolist()) for i in range(n)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    check(whitening.embedding_whitening(table), [(r["vec_id"], r["embedding"]) for r in table.collect()], 20)


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(4)], SCHEMA)
    assert whitening.embedding_whitening(one).count() == 0
    assert whitening.embedding_whitening(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.embedding_whitening(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [float("nan")], 1)], SCHEMA)).count() == 0


def test_deviations_are_exact_or_null(spark):
    centre = whitening.Centre(3, (3 * 10**9, 5, 7))
    x = np.array([[10**9, 2, 2], [10**9 + 1, 1, 3], [10**9 - 1, 2, 2]])
    plain_ = [sum((3 * int(c) - s) ** 2 for c, s in zip(r, centre.sums, strict=True)) for r in x.tolist()]
    assert centre.deviation(x) == plain_
    big = whitening.Centre(10**6, (0, 0, 0))
    assert big.deviation(np.array([[3000, 1, 0], [4_000_000, 0, 0]])) == [10**12 * 9_000_001, None]


def test_query_reads_its_whole_table(spark, tmp_path):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(i, (rng.standard_normal(64) / 8).tolist(), 0) for i in range(200)], SCHEMA)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    check(entry.queries()["op13_jacobi_davidson_whitening"](spark, str(tmp_path)), [(r["vec_id"], r["embedding"]) for r in table.collect()], 64)

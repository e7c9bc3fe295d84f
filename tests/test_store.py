"""Stores with one pointer, append-only tables, resumable embedding and its activation, reconciliation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import governance, lifecycle
from engram.sources import snapshots


def numbers(df):
    return None if df is None else sorted(r[0] for r in df.collect())


def test_tables_of_a_store_move_together(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    assert snapshots.state(spark, root) == snapshots.State() and snapshots.table(spark, root, "a") is None
    one = snapshots.commit(spark, root, {"a": spark.range(2), "b": spark.range(3)}, {"log": spark.range(1)}, job="j", batch=0)
    write = snapshots._write

    def stops_at(name):
        def broken(df, path):
            if f"/{name}/" in path:
                raise OSError("stopped")
            write(df, path)

        return broken

    for name in ("a", "b", "log"):
        monkeypatch.setattr(snapshots, "_write", stops_at(name))
        with pytest.raises(OSError):
            snapshots.commit(spark, root, {"a": spark.range(5), "b": spark.range(6)}, {"log": spark.range(7)}, job="j", batch=1)
        assert [numbers(snapshots.table(spark, root, t)) for t in "ab"] == [[0, 1], [0, 1, 2]]
        assert numbers(snapshots.log(spark, root, "log", "id long")) == [0] and snapshots.state(spark, root) == one
    monkeypatch.setattr(snapshots, "_write", write)
    two = snapshots.commit(spark, root, {"a": spark.range(5)}, {"log": spark.range(2)}, job="j", batch=1)
    assert snapshots.commit(spark, root, {"a": spark.range(9)}, {"log": spark.range(9)}, job="j", batch=1) == two  # done already
    assert [numbers(snapshots.table(spark, root, t)) for t in "ab"] == [[0, 1, 2, 3, 4], [0, 1, 2]]
    assert numbers(snapshots.log(spark, root, "log", "id long")) == [0, 0, 1]
    # readers of the state before
    assert numbers(snapshots.table(spark, root, "a", one)) == [0, 1] and numbers(snapshots.log(spark, root, "log", "id long", one)) == [0]
    assert snapshots.state(spark, root, 1) == one
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, root, {"a": spark.range(1)}, before=one)


def test_what_was_never_committed_stays_out_of_a_log(spark, tmp_path, monkeypatch):
    """A job stopped before the pointer moved; another one then takes its number without touching the log."""
    root = f"file://{tmp_path}/store"
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_point", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            snapshots.commit(spark, root, {}, {"log": spark.range(4)})
    snapshots.commit(spark, root, {"a": spark.range(1)})
    assert numbers(snapshots.log(spark, root, "log", "id long")) == []


def test_append_counts_a_batch_once(spark, tmp_path):
    at = f"file://{tmp_path}/rows"
    rows = lambda *pairs: spark.createDataFrame(pairs, "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert snapshots.appended(spark, at, "id long, ts timestamp").count() == 0
    snapshots.append(rows((1, "2024-01-01 10:00:00"), (2, "2024-01-02 00:00:00")), at, "ts", 0)
    snapshots.append(rows((3, "2024-01-02 10:00:00")), at, "ts", 1)
    for again in (rows((3, "2024-01-02 10:00:00")), rows((3, "2024-01-02 10:00:00"), (4, "2024-01-03 10:00:00"))):
        snapshots.append(again, at, "ts", 1)
    out = snapshots.appended(spark, at, "id long, ts timestamp")
    assert sorted((r["id"], str(r["date"]), r["batch"]) for r in out.collect()) == [(1, "2024-01-01", 0), (2, "2024-01-02", 0), (3, "2024-01-02", 1), (4, "2024-01-03", 1)]
    assert out.filter("date = '2024-01-02'").count() == 2


def stories_of(spark, rows):
    return spark.createDataFrame(rows, "story_id long, content_hash string, text string, active boolean")


def vectorise(bad):
    return lambda text: F.when(~text.isin(*bad), F.array(F.lit(1.0), F.length(text).cast("double"), F.lit(0.0)))


def test_embedding_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    rows = [(i, f"h{i}", f"text {i}", i != 7) for i in range(40)]
    stories = stories_of(spark, rows)
    tried = lambda: snapshots.log(spark, root, "attempts", lifecycle.ATTEMPTS)
    commit, n = snapshots.commit, []

    def stops(*args, **kwargs):
        n.append(1)
        if len(n) == 3:
            raise OSError("stopped")
        return commit(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", stops)
        with pytest.raises(OSError):
            lifecycle.reembed_in_slices(stories, root, "m1", vectorise(["text 3"]), 3, slices=6)
    before = {r["story_id"] for r in tried().collect()}
    assert 0 < len(before) < 39
    assert not lifecycle.activate_embeddings(stories, root, "m1", 3) and snapshots.table(spark, root, "vectors") is None
    lifecycle.reembed_in_slices(stories, root, "m1", vectorise(["text 3"]), 3, slices=6)
    counts = {r["story_id"]: r["attempts"] for r in lifecycle.attempts_ledger(tried(), "m1").collect()}
    assert set(counts) == {i for i in range(40) if i != 7} and {c for i, c in counts.items() if i != 3} == {1}
    # only the story that failed is left, until its attempts are used up
    for _ in range(4):
        lifecycle.reembed_in_slices(stories, root, "m1", vectorise(["text 3"]), 3, slices=6)
    ledger = {r["story_id"]: (r["attempts"], r["status"]) for r in lifecycle.attempts_ledger(tried(), "m1").collect()}
    assert ledger[3] == (3, "failed") and tried().count() == 38 + 3
    assert not lifecycle.activate_embeddings(stories, root, "m1", 3)
    # a text that has changed starts anew
    mended = stories_of(spark, [(i, h + "b" if i == 3 else h, t + "!" if i == 3 else t, a) for i, h, t, a in rows])
    assert lifecycle.reembed_in_slices(mended, root, "m1", vectorise(["text 3"]), 3, slices=6) == 1
    assert lifecycle.activate_embeddings(mended, root, "m1", 3)
    served = snapshots.table(spark, root, "vectors")
    assert {r["story_id"] for r in served.collect()} == set(range(40)) - {7} and snapshots.table(spark, root, "identity").first()["identity"] == "m1"
    old = snapshots.state(spark, root)
    # another model: the one that serves stays until all stories are ready
    lifecycle.reembed_in_slices(mended, root, "m2", vectorise(["text 5"]), 3, slices=2)
    assert not lifecycle.activate_embeddings(mended, root, "m2", 3)
    assert snapshots.table(spark, root, "identity").first()["identity"] == "m1"
    lifecycle.reembed_in_slices(mended, root, "m2", vectorise([]), 3, slices=2)
    assert lifecycle.activate_embeddings(mended, root, "m2", 3)
    assert snapshots.table(spark, root, "identity").first()["identity"] == "m2"
    assert snapshots.table(spark, root, "identity", old).first()["identity"] == "m1" and snapshots.table(spark, root, "vectors", old).count() == 39


def test_nothing_to_serve_is_not_served(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    none = stories_of(spark, [(1, "h", "t", False)])
    assert lifecycle.reembed_in_slices(none, root, "m", vectorise([]), 3) == 0
    assert not lifecycle.activate_embeddings(none, root, "m", 3)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_reconciliation_like_a_walk(spark, buckets):
    """Nulls that move between columns, repeated keys, a null key, rows on one side only."""
    rng = random.Random(buckets)
    make = lambda i: (i, rng.choice(["a", "b", None]), rng.choice(["a", "b", None]), rng.choice([[1.0], [2.0], None]))
    old = [make(i) for i in range(120)] + [make(5), make(5), make(None)]
    new = [r if rng.random() < 0.8 else make(r[0]) for r in old if rng.random() < 0.9] + [make(i) for i in range(120, 130)]
    old.append((500, "a", None, [1.0]))
    new.append((500, None, "a", [1.0]))
    schema = "id long, title string, body string, vector array<double>"
    parts = {"content": ("title", "body"), "vectors": ("vector",)}
    bags = []
    for rows in (old, new):
        bag = {}
        for i, t, b, v in rows:
            bag.setdefault(i, []).append(((t, b), tuple(v) if v else v))
        bags.append(bag)
    want = {}
    for i in bags[0].keys() | bags[1].keys():
        a, b = (bag.get(i) for bag in bags)
        if a is None or b is None:
            want[i] = ("added" if a is None else "missing", [])
        else:
            differs = (["rows"] if len(a) != len(b) else []) + [name for k, name in enumerate(parts) if sorted(map(repr, (x[k] for x in a))) != sorted(map(repr, (x[k] for x in b)))]
            if differs:
                want[i] = ("changed", differs)
    out = governance.reconcile(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", parts, buckets)
    assert {r["id"]: (r["state"], r["parts"]) for r in out.collect()} == want
    same = spark.createDataFrame(old, schema)
    assert governance.reconcile(same, same.repartition(5), "id", parts, buckets).count() == 0


def test_fingerprints_know_rows_not_their_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "a long, b string")
    first = governance.fingerprint(rows).first()
    assert governance.fingerprint(rows.orderBy(F.desc("a")).repartition(2)).first() == first and first["n"] == 3
    assert governance.fingerprint(rows.dropDuplicates()).first() != first

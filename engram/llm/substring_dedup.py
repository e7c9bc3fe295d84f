"""Substring dedup by level-wise doubling.

A window of `least` words that comes twice holds, at the same place in both, the same shorter windows. So the search
starts with windows of half the length, and only those that repeat are extended to twice that length. At the first
level one window in about ten is enough: of the half-length windows inside a full-length one, the one with the smallest
hash is taken (its anchor), which is the same one wherever the full window occurs. Texts stay where they are until they
are known to hold something that repeats. What repeats at full length decides what is removed; it is doubled on, until no
candidates survive, to say how long the repeats of a document are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import Slice, map_batches, numbered, polynomial, signed, slices, spread, take, window_hashes

LEAST = 35
_SECOND = 0x6A09E667F3BCC909
_PLACE_BITS = np.uint64(30)


def _first_smallest(hashes: np.ndarray, wide: int) -> np.ndarray:
    """For every run of `wide` hashes, the place of its first smallest (by the upper 34 bits)."""
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes >> _PLACE_BITS << _PLACE_BITS) | place
    step = 1
    while step < wide:
        jump = min(step, wide - step)
        low = np.minimum(low[:-jump], low[jump:])
        step += jump
    return (low & np.uint64((1 << 30) - 1)).astype(np.int64)


def _starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a window of `length` words of one document starts, and that document."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    owner, inner = spread(counts)
    return first[:-1][owner] + inner, owner


def anchors(docs: DataFrame, least: int, half: int) -> DataFrame:
    """A row per anchor: doc_id, row, the first window start `lo` that it serves and how many follow (`n`), the hash of
    the half-length window at the anchor, and the hash of all words that its windows cover.

    Where docs has `ranges`, the half-length windows known to repeat, only windows both of whose halves do are looked at.
    """
    extends = "ranges" in docs.columns

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            starts, ends, first = part.words()
            at, owner = _starts(first, least)
            if extends and len(at):
                lo, n, _ = _ranges(batch, part, "ranges", first)
                again = np.zeros(len(starts) + 1, np.int64)
                np.add.at(again, lo, 1)
                np.add.at(again, lo + n, -1)
                again = np.cumsum(again) > 0
                both = again[at] & again[at + least - half]
                at, owner = at[both], owner[both]
            if not len(at):
                continue
            words = part.word_hashes(starts, ends)
            here = np.arange(len(words) - half + 1)
            halves = window_hashes(words, here, here + half)
            anchor = _first_smallest(halves, least - half + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
            lead = np.flatnonzero(new)
            n = np.diff(np.append(lead, len(at)))
            lo, anchor, owner = at[lead], anchor[lead], owner[lead]
            # the place of the anchor and the number of windows are part of what must be equal
            span = window_hashes(words, lo, lo + n - 1 + least) ^ ((anchor - lo).astype(np.uint64) << np.uint64(32)) ^ n.astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [take(batch.column(0), part.rows, owner), take(batch.column(1), part.rows, owner), pa.array((lo - first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), signed(halves[anchor]), signed(span)],
                names=["doc_id", "row", "lo", "n", "half", "span"],
            )

    return map_batches(docs, work, "doc_id long, row long, lo int, n int, half long, span long")


def _ranges(batch: pa.RecordBatch, part: Slice, column: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The listed ranges (lo, n) of a slice's documents: word index of each lo, n, and the document."""
    lists = batch.column(column).slice(part.rows.start, len(part.rows))
    flat = lists.flatten()
    counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    return first[owner] + flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64), owner


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"doc_id": "l_id", "row": "l_row"})
    on = F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("row").eqNullSafe(F.col("l_row"))
    return docs.join(lists.hint("merge"), on, how).drop("l_id", "l_row")


def _windows(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The full windows of the wanted ranges: doc_id, row, start, done, and two hashes of their words, so that windows
    of a large corpus don't meet by chance."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            starts, ends, first = part.words()
            words = part.word_hashes(starts, ends)
            lo, n, owner = _ranges(batch, part, "ranges", first)
            done = batch.column("ranges").slice(part.rows.start, len(part.rows)).flatten().field("done").to_numpy(zero_copy_only=False)
            group, inner = spread(n)
            at = lo[group] + inner
            yield pa.RecordBatch.from_arrays(
                [take(batch.column(0), part.rows, owner[group]), take(batch.column(1), part.rows, owner[group]), pa.array((at - first[owner[group]]).astype(np.int32)), pa.array(done[group]), signed(window_hashes(words, at, at + least)), signed(polynomial(words, at, at + least, _SECOND))],
                names=["doc_id", "row", "start", "done", "hash", "again"],
            )

    return map_batches(_with_lists(docs, wanted, "inner"), work, "doc_id long, row long, start int, done boolean, hash long, again long")


def repeated_ranges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, row, lo, n: the windows of `least` words that start at word lo, lo+1, .. lo+n-1 of the document occur
    somewhere else as well. docs has doc_id, row, text, and `ranges` of half-length windows if those are known."""
    half = (least + 1) // 2
    found = materialize(anchors(docs, least, half), "anchors")
    again = found.groupBy("half").agg(F.count("*").alias("times"), F.min("span").alias("low"), F.max("span").alias("high"))
    again = materialize(again.filter("times > 1").select("half", (F.col("low") != F.col("high")).alias("mixed")), "repeated-halves")
    live = materialize(found.join(again.hint("merge"), "half"), "live-anchors")
    # where all occurrences of an anchor agree on all the words its windows cover, every window repeats
    agreed = live.filter("not mixed").select("doc_id", "row", "lo", "n")
    mixed = live.filter("mixed")
    spans = materialize(mixed.groupBy("half", "span").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "row", "lo", "n")).alias("one")), "spans")
    same = mixed.join(spans.filter("times > 1").select("half", "span").hint("merge"), ["half", "span"]).select("doc_id", "row", "lo", "n")
    # the rest is extended to the full length, one occurrence for each distinct stretch of words
    wanted = spans.select("one.*", (F.col("times") > 1).alias("done")).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "n", "done")).alias("ranges"))
    full = materialize(_windows(docs.select("doc_id", "row", "text"), wanted, least), "full-windows")
    twice = materialize(full.groupBy("hash", "again").agg(F.count("*").alias("times")).filter("times > 1").select("hash", "again"), "repeated-windows")
    matched = full.filter("not done").join(twice.hint("merge"), ["hash", "again"]).select("doc_id", "row", F.col("start").alias("lo"), F.lit(1).alias("n"))
    return agreed.unionByName(same).unionByName(matched)


def _listed(ranges: DataFrame, name: str) -> DataFrame:
    return materialize(ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "n")).alias("ranges")), name)


def _runs(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """The stretches of words whose every window of `length` words repeats, where twice that length fits in: the document,
    its holder, the first word `lo`, how many words (`n`), a hash of them and the last length of the doubling that fits."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            starts, ends, first = part.words()
            lo, n, _ = _ranges(batch, part, "ranges", first)
            again = np.zeros(len(starts) + 1, np.int64)
            np.add.at(again, lo, 1)
            np.add.at(again, lo + n, -1)
            again = np.cumsum(again) > 0
            new = again.copy()
            new[1:] &= ~again[:-1]
            new[first[:-1]] = again[first[:-1]]
            at = np.flatnonzero(new)
            if not len(at):
                continue
            size = np.add.reduceat(again.astype(np.int64), at) - 1 + length
            at, size = at[size >= 2 * length], size[size >= 2 * length]
            owner = np.searchsorted(first, at, side="right") - 1
            whole = window_hashes(part.word_hashes(starts, ends), at, at + size)
            level = length << (np.frexp(size // length)[1].astype(np.int64) - 1)
            yield pa.RecordBatch.from_arrays(
                [*(take(batch.column(c), part.rows, owner) for c in ("doc_id", "row", "h_id", "h_row", "open")), pa.array((at - first[owner]).astype(np.int32)), pa.array(size.astype(np.int32)), signed(whole), pa.array(level)],
                names=["doc_id", "row", "h_id", "h_row", "open", "lo", "n", "whole", "level"],
            )

    return map_batches(_with_lists(docs, lists, "inner"), work, "doc_id long, row long, h_id long, h_row long, open boolean, lo int, n int, whole long, level long")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of the wanted stretches, named by the hash of their words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            starts, ends, first = part.words()
            lo, n, _ = _ranges(batch, part, "ranges", first)
            flat = batch.column("ranges").slice(part.rows.start, len(part.rows)).flatten()
            raw = part.data.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[lo].tolist(), ends[lo + n - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("whole"), pa.array(np.zeros(len(texts), np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), flat.field("h_id"), flat.field("h_row"), flat.field("open")],
                names=["doc_id", "row", "text", "h_id", "h_row", "open"],
            )

    return map_batches(_with_lists(docs.select("doc_id", "row", "text"), wanted, "inner"), work, "doc_id long, row long, text string, h_id long, h_row long, open boolean")


def _settled(docs: DataFrame, lists: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Levels of the stretches that come twice as a whole, whose every window repeats up to their own length; and one
    occurrence of each distinct stretch. Those that came once are still open."""
    found = materialize(_runs(docs, lists, length), "stretches")
    one = F.min(F.struct("doc_id", "row", "lo", "h_id", "h_row", "open")).alias("one")
    each = materialize(found.groupBy("whole", "n").agg(F.count("*").alias("times"), one), "distinct-stretches")
    levels = found.filter("open").join(each.filter("times > 1").select("whole", "n").hint("merge"), ["whole", "n"]).select("h_id", "h_row", "level")
    each = each.select("one.doc_id", "one.row", F.struct("one.lo", "n", "whole", "one.h_id", "one.h_row", (F.col("one.open") & (F.col("times") == 1)).alias("open")).alias("range"))
    return levels, materialize(_cut(docs, each.groupBy("doc_id", "row").agg(F.collect_list("range").alias("ranges"))), "stretch-texts")


def longest_levels(docs: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """doc_id, row, longest: the last length of the doubling at which a window of the document repeats.

    Windows that repeat at one length alone are extended to twice that length, until no candidates survive. lists has
    the windows of `least` words that repeat, as `ranges` per document. From one length to the next only stretches of
    such windows travel, one of each kind; a stretch that comes twice as a whole, a copied document above all, needs no
    doubling and stays only for others to be met with.
    """
    levels, length = [lists.select(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row"), F.lit(least).cast("long").alias("level"))], least
    docs = docs.select("doc_id", "row", "text", F.col("doc_id").alias("h_id"), F.col("row").alias("h_row"), F.lit(True).alias("open"))
    more, docs = _settled(docs, lists, length)
    levels.append(more)
    while not docs.filter("open").isEmpty():
        length *= 2
        lists = _listed(repeated_ranges(docs.select("doc_id", "row", "text"), length), "longer")
        reached = docs.filter("open").join(lists.select("doc_id").hint("merge"), "doc_id").select("h_id", "h_row", F.lit(length).cast("long").alias("level"))
        more, docs = _settled(docs, lists, length)
        levels += [reached, more]
    best = reduce(DataFrame.unionByName, levels).groupBy("h_id", "h_row").agg(F.max("level").alias("longest"))
    return materialize(best.withColumnsRenamed({"h_id": "doc_id", "h_row": "row"}), "longest")


def _removed(docs: DataFrame, lists: DataFrame, longest: DataFrame, least: int) -> DataFrame:
    lists = lists.join(longest.hint("merge"), lists["doc_id"].eqNullSafe(longest["doc_id"]) & lists["row"].eqNullSafe(longest["row"])).select(lists["doc_id"], lists["row"], "ranges", "longest")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            starts, ends, first = part.words()
            lo, n, owner = _ranges(batch, part, "ranges", first)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, np.minimum(lo + n - 1 + least, first[1:][owner]), -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            raw = part.data.tobytes()
            texts = []
            for i in range(len(part.rows)):
                if removed[i]:
                    own = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    texts.append(b" ".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
                else:  # bytes are split at the same six kinds of white space
                    texts.append(b" ".join(raw[part.off[i] : part.off[i + 1]].split()))
            yield pa.RecordBatch.from_arrays(
                [take(batch.column(0), part.rows, np.arange(len(texts))), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), batch.column("longest").slice(part.rows.start, len(part.rows)).fill_null(0)],
                names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "longest"],
            )

    return map_batches(_with_lists(docs, lists, "left"), work, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, longest long")


def substring_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Remove every word that a window of `least` words covers whose word sequence also starts anywhere else.

    Returns doc_id, text (the words that are left, joined by one space), n_words, n_removed, kept_sha256 and
    longest (the last length of the doubling at which one of its windows repeats, 0 if none does) for every row. What
    repeats at `least` decides what is removed. Windows are judged on the input, in the same document as in others. Null
    and empty texts have no words. A document of fewer than `least` words keeps all; a very long one is read whole. Rows
    that repeat count as copies of each other; of equal windows none is preferred, all go. A null doc_id is like any
    other value. Empty tables give empty tables; columns other than doc_id and text are ignored.
    """
    docs = numbered(docs)
    lists = _listed(repeated_ranges(docs, least), "covered")
    return _removed(docs, lists, longest_levels(docs, lists, least), least)

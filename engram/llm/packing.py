"""Best-fit packing by exact-complement hashing.

Texts are tokenised where they lie and only lengths leave the tasks. The histogram of piece lengths (as many entries as
a sequence has tokens, whatever the number of documents) is packed on the driver: hash tables of single, pair and triple
sums say which lengths fill a gap exactly, such combinations are consumed as often as their counts allow, and what is
left is packed best-fit. Pieces then find their sequence by their rank among pieces of the same length, which needs a
count per task and length and no ordering of all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import vocab
from engram.llm.stages import materialize
from engram.llm.textbatch import SPACE_LUT, slices

SEQUENCE = 2048
#: Id that ends every document.
END = 0


def tokenised(docs: DataFrame, path: str, length: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its task and rank among the task's pieces of that length.

    A document has its ids and then id 0. Only one longer than a sequence is cut: its first piece takes the remainder.
    """
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    # white space in the sense of the vocabulary's pattern can be any Unicode space: next to one, no cut is made
    space = SPACE_LUT.copy()
    space[0x80:] = False
    space[[0x1C, 0x1D, 0x1E, 0x1F]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = vocab.ChunkIds(path)
        seen = np.zeros(length + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch.column(1)):
                cuts = vocab.chunks_of(part.data, part.off, space)
                chunks, number = vocab.distinct(part.data, cuts)
                ids = ids_of.of(chunks)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
                at = np.concatenate([[0], np.cumsum(size)])
                counts = size[number] if len(number) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(counts)])
                source = np.repeat(at[number] - total[:-1], counts) + np.arange(total[-1]) if len(number) else np.zeros(0, np.int64)
                stream = flat[source]
                bounds = total[np.searchsorted(cuts, part.off)] if len(part.data) else np.zeros(len(part.off), np.int64)
                out: list[list] = [[], [], [], [], [], []]
                for row, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = np.append(stream[lo:hi], np.uint32(END)).astype("<u4")
                    first = len(own) % length or length
                    edges = [0, *range(first, len(own) + 1, length)]
                    for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        for column, value in zip(out, (row, piece, a, b - a, zlib.crc32(own[a:b].tobytes()), seen[b - a]), strict=True):
                            column.append(value)
                        seen[b - a] += 1
                owner = np.array(out[0], np.int64)
                doc = batch.column(0).slice(part.rows.start, len(part.rows)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(np.full(len(owner), task, np.int64)), pa.array(out[5], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
                )

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long")


class Plan:
    """Segments (length, first rank, sequence of the first, offset): ranks that follow go to sequences that follow."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def put(self, pattern: list[int], times: int, used: np.ndarray) -> None:
        """`times` sequences that each hold the lengths of pattern in turn."""
        at = 0
        for size in pattern:  # a length that comes twice takes two runs of ranks
            self.rows.append((size, int(used[size]), self.sequences, at))
            used[size] += times
            at += size
        self.sequences += times


class SumIndex:
    """Which lengths, pairs and triples of lengths have a given sum, under the counts that are left.

    Sums are small numbers, so the index is addressed by the sum itself: a count per length, and a mark for every sum
    that some pair and some triple has. What a mark stands for is looked up among the lengths when it is consumed.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        live = (left > 0).astype(np.float64)
        # sums that some pair has; a pair that has since been used up is found out when it is looked for
        spectrum = np.fft.rfft(live, 2 * len(live))
        self.paired = np.rint(np.fft.irfft(spectrum * spectrum, 2 * len(live)))[: len(live)] > 0
        pairs = np.fft.rfft(self.paired.astype(np.float64), 2 * len(live))
        self.tripled = np.rint(np.fft.irfft(pairs * spectrum, 2 * len(live)))[: len(live)] > 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair of this sum whose parts are most alike."""
        if gap < 2 or not self.paired[gap]:
            return None
        small = np.arange(1, gap // 2 + 1)
        found = np.flatnonzero((self.left[small] > 0) & (self.left[gap - small] > (small == gap - small)))
        if not len(found):
            self.paired[gap] = False
            return None
        a = int(small[found[-1]])
        return [gap - a, a]

    def triple(self, gap: int) -> list[int] | None:
        """A triple of this sum, its largest part as large as can be."""
        if not self.tripled[gap]:
            return None
        for a in np.flatnonzero((self.left[:gap] > 0) & self.paired[gap:0:-1])[::-1]:
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return sorted([int(a), *rest], reverse=True)
        self.tripled[gap] = False
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan_lengths(counts: np.ndarray, length: int) -> Plan:
    """Pack a histogram: counts[n] pieces of n tokens, into sequences of `length`.

    From the longest length down, a piece opens a gap; the index of single, pair and triple sums names a combination
    that fills it exactly, and it is consumed as often as the counts allow. Where there is none, the largest length
    that fits goes in and the smaller gap is looked up again, until nothing fits (best fit for the rest).
    """
    left, used, plan = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), Plan()
    left[0] = 0
    index = SumIndex(left)
    for size in np.flatnonzero(left)[::-1].tolist():
        while left[size] > 0:
            pattern, gap = [size], length - size
            left[size] -= 1
            while gap > 0:
                fill = index.exact(gap)
                if fill is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    fill = [int(fits[-1])]
                for n in fill:
                    left[n] -= 1
                pattern += fill
                gap -= sum(fill)
            need = {n: pattern.count(n) for n in set(pattern)}
            more = min(int(left[n]) // k for n, k in need.items())
            for n, k in need.items():
                left[n] -= more * k
            plan.put(pattern, more + 1, used)
    return plan


def place(pieces: DataFrame, plan: Plan, length: int) -> DataFrame:
    """sequence_id and offset of every ranked piece. The plan is bounded by the sequence length, not by the data."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 4)
    first = np.searchsorted(rows[:, 0], np.arange(length + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            segment = np.zeros(len(size), np.int64)
            for n in np.unique(size):
                own, at = size == n, slice(first[n], first[n + 1])
                segment[own] = first[n] + np.searchsorted(rows[at, 1], rank[own], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(rows[segment, 2] + rank - rows[segment, 1]), pa.array(rows[segment, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return pieces.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Pack whole documents into as few sequences of `length` tokens as the method finds.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    the end id alone. Repeated rows, and rows that share a doc_id, are packed as documents of their own. A null doc_id
    stays null. An empty table gives an empty table. Columns other than doc_id and text are ignored. Ties between
    equal lengths are broken by the pieces' place in the input. Very long texts are encoded whole and cut into pieces.
    """
    pieces = materialize(tokenised(docs, path or vocab.default_path("byte_bpe_50k.tiktoken"), length), "pieces")
    per_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(length + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        counts[row["length"]] = row["n"]
    plan = plan_lengths(counts, length)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan, length)

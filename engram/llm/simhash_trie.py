"""SimHash near-dedup by a binary trie that is joined with itself.

Fingerprints are made next to the text. Distinct ones then form a binary trie: a pair of its nodes is walked down
together, the bits in which the two sides differ add up, and a pair that has used up its budget is dropped with all
that lies below it. The work is shared out by fixed blocks of bits: of budget + 1 blocks, two fingerprints that differ
in `budget` bits or fewer have one in common, so each fingerprint goes to one group per block, whatever the size of the
table. A group that is crowded is shared out again by blocks of the bits that are still free. Groups are walked many at
a time, in tasks that keep only a spanning forest of the links they find.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.components import components
from engram.llm.stages import materialize
from engram.llm.textbatch import LOWER_LUT, Slice, map_batches, row_key, signed, slices, take

BUDGET = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a group holds at most (more than lie within three bits of any one, so that blocks part a crowd),
#: leaves that are walked together, and node pairs that are walked at once.
CROWD = 1 << 17
LEAVES = 1 << 16
FRONT = 1 << 18


def _bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each group hashes[bounds[i]:bounds[i+1]]: bits that are set in over half of it."""
    n = len(bounds) - 1
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    counts = np.diff(bounds)
    some = counts > 0
    at = bounds[:-1][some]
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), at)
        out[some] |= (2 * ones > counts[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the 64-bit SimHash of its word shingles (as a signed long) and the carried columns for every row of doc_id, text."""
    import xxhash  # noqa: F401  fails on the driver, not in a task, where it is missing

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in slices(batch.column(1)):
            part = Slice(part.rows, LOWER_LUT[part.data], part.off)
            starts, ends, first = part.words()
            # words of a document next to each other with one space between, so that a shingle is one stretch of bytes
            length = ends - starts
            to = np.cumsum(length + 1) - length - 1
            squeezed = np.full(int(length.sum()) + len(length), 32, np.uint8)
            word = np.repeat(np.arange(len(length)), length)
            inner = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
            squeezed[to[word] + inner] = part.data[starts[word] + inner]
            raw, stop = squeezed.tobytes(), to + length
            n_words = np.diff(first)
            counts = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            owner = np.repeat(np.arange(len(counts)), counts)
            at = first[:-1][owner] + np.arange(len(owner)) - bounds[:-1][owner]
            last = np.minimum(at + shingle, first[1:][owner]) - 1
            hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(to[at].tolist(), stop[last].tolist(), strict=True)), np.uint64, len(at))
            others = [batch.column(2 + i).slice(part.rows.start, len(part.rows)) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([take(batch.column(0), part.rows, np.arange(len(counts))), signed(_bits(hashes, bounds)), *others], names=["doc_id", "fp", *carry])

    schema = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *carry), work, f"doc_id long, fp long{schema}")


def blocks_of(mask: int, count: int) -> list[int]:
    """The bits that a mask leaves free, from the highest, as `count` masks of about the same width."""
    free = [1 << b for b in range(63, -1, -1) if not mask >> b & 1]
    edges = [len(free) * i // count for i in range(count + 1)]
    return [sum(free[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


class _Forest:
    """Links between the leaves of a task, kept as a label per leaf; linked leaves end with the same label."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:  # every leaf points at the end of its chain again
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def walk(values: np.ndarray, bounds: np.ndarray, budget: int) -> np.ndarray:
    """Join the trie of each group, values[bounds[i]:bounds[i+1]], with itself and return a label per leaf.

    Groups are sorted, so a node is a range of leaves. First the walk runs with a budget of one bit, which is cheap
    and ties the leaves of a crowded part together; in the full walk a pair of nodes whose leaves are tied already is
    passed over. So many near copies cost no more than a walk over them, and no list of their pairs is made.
    """
    forest = _Forest(len(values))
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(b)) & np.uint64(1), dtype=np.int32)]) for b in range(63, -1, -1)]
    for allowed in sorted({min(1, budget), budget}):
        lo, hi = bounds[:-1], bounds[1:]
        stack = [(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)], 1).astype(np.int32))]
        tied_at = None
        while stack:
            depth, front = stack.pop()
            if tied_at is not forest.label:
                tied_at = forest.label
                changes = np.concatenate([[0], np.cumsum(tied_at[1:] != tied_at[:-1])])
            a, a_end, b, b_end = front[:, 0], front[:, 1], front[:, 2], front[:, 3]
            open_ = ~((tied_at[a] == tied_at[b]) & (changes[a] == changes[a_end - 1]) & (changes[b] == changes[b_end - 1]))
            front = front[open_]
            few = (front[:, 1] - front[:, 0]).astype(np.int64) * (front[:, 3] - front[:, 2]) <= 16
            if depth == 64:
                few[:] = True
            if few.any():
                small = front[few]
                wide = (small[:, 3] - small[:, 2]).astype(np.int64)
                counts = (small[:, 1] - small[:, 0]) * wide
                owner = np.repeat(np.arange(len(small)), counts)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                left, right = small[owner, 0] + inner // wide[owner], small[owner, 2] + inner % wide[owner]
                near = (left < right) & (np.bitwise_count(values[left] ^ values[right]) <= allowed)
                forest.link(left[near], right[near])
            front = front[~few]
            if not len(front):
                continue
            count = ones[depth]
            a, a_end, b, b_end, far = front.T
            a_mid, b_mid = a_end - (count[a_end] - count[a]), b_end - (count[b_end] - count[b])
            same = (a == b) & (a_end == b_end)
            down = [np.stack([a, a_mid, b, b_mid, far], 1), np.stack([a_mid, a_end, b_mid, b_end, far], 1)]
            more = far < allowed
            down.append(np.stack([a, a_mid, b_mid, b_end, far + 1], 1)[more])
            down.append(np.stack([a_mid, a_end, b, b_mid, far + 1], 1)[more & ~same])
            front = np.concatenate(down)
            front = front[(front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2])]
            for i in range(0, len(front), FRONT):
                stack.append((depth + 1, front[i : i + FRONT]))
    return forest.label


def deal(rows: DataFrame, budget: int) -> DataFrame:
    """mask, part, fp: each fingerprint of (mask, fp) goes to budget + 1 groups, by its bits in mask and in one of as
    many blocks of the others."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        masks, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        for mask in np.unique(masks).tolist():
            own = fp[masks == np.uint64(mask)]
            for block in blocks_of(mask, budget + 1):
                both = np.uint64(mask | block)
                yield pa.RecordBatch.from_arrays([signed(np.full(len(own), both)), signed(own & both), signed(own)], names=["mask", "part", "fp"])

    return map_batches(rows, work, "mask long, part long, fp long")


def _walked(dealt: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) of groups that fit in memory: whole groups, LEAVES fingerprints or one group at a time."""

    def join(values: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        label = walk(values, bounds, budget)
        linked = label != np.arange(len(values))
        return pa.RecordBatch.from_arrays([signed(values[linked]), signed(values[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.uint64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3)])], axis=1)
            if rest.shape[1] >= LEAVES:
                new = np.flatnonzero((rest[:2, 1:] != rest[:2, :-1]).any(0)) + 1
                if len(new):  # the last group may go on in the next batch
                    yield join(rest[2, : new[-1]], np.concatenate([[0], new]))
                    rest = rest[:, new[-1] :]
        if rest.shape[1]:
            new = np.flatnonzero((rest[:2, 1:] != rest[:2, :-1]).any(0)) + 1
            yield join(rest[2], np.concatenate([[0], new, [rest.shape[1]]]))

    return dealt.repartition("mask", "part").sortWithinPartitions("mask", "part", F.col("fp") < 0, "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """A spanning set (a, b) of the links between fingerprints that differ in `budget` bits or fewer.

    distinct has one column, fp, without repeats. Groups of more than `crowd` fingerprints are dealt out again by the
    bits that they don't share, until none is left.
    """
    rows, found = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while True:
        dealt = materialize(deal(rows, budget), "dealt")
        crowded = materialize(dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("mask", "part"), "crowded")
        if crowded.isEmpty():
            found.append(_walked(dealt, budget))
            return reduce(DataFrame.unionByName, found)
        found.append(_walked(dealt.join(crowded.hint("merge"), ["mask", "part"], "left_anti"), budget))
        rows = dealt.join(crowded.hint("merge"), ["mask", "part"], "left_semi").select("mask", "fp")


def _components(prints: DataFrame, budget: int) -> DataFrame:
    """fp, least (its smallest doc_id) and component (a fingerprint that names it) of every distinct fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), budget))
    named = distinct.join(found.hint("merge"), distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return materialize(named, "named")


def representatives(docs: DataFrame, row: str, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """The value of column `row`, a long that tells all rows apart, for one row of each component: that with the smallest
    doc_id, nulls last; of those, with the smallest hash of its text, then the smallest `row`."""
    keyed = docs.select("doc_id", "text", row_key(docs["text"].cast("string")).alias("tkey"), F.col(row).alias("row"))
    prints = materialize(fingerprints(keyed, shingle, ("tkey", "row")), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tkey", "row")).alias("first"))
    named = _components(prints, budget).select("fp", "component")
    each = materialize(first, "first-rows").join(named.hint("merge"), "fp").groupBy("component").agg(F.min("first").alias("first"))
    return materialize(each.select(F.col("first.row").alias(row)), "representatives")


def near_dedup(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, fingerprint and component_id (the smallest doc_id that links lead to) for every row.

    A-Z count as lower case. A text of fewer words than a shingle has its whole word sequence as one; null, empty and
    blank texts have fingerprint zero, and are linked like any other. Repeated rows are copies. A null doc_id is passed
    over when the smallest is taken; a component of nulls alone has component_id null. Ties can't occur. Empty tables
    give empty tables; columns other than doc_id and text are ignored. Very long texts are fingerprinted whole.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    named = _components(prints, budget)
    low = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    of_fp = named.select("fp", "component").join(low.hint("merge"), "component").select("fp", "component_id")
    of_fp = materialize(of_fp, "fingerprint-components")
    return prints.join(of_fp.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

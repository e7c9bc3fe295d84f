"""Vector search: every query against every story, block by block.

Queries are read in blocks of a fixed size; a block goes to the tasks as one matrix, each task multiplies it with the
vectors it reads, a tile of queries and stories at a time, and keeps the best k per query. What is shuffled is k rows per
query and task, whatever the number of stories, and the last choice among them is a window that stops at k. Where only
pairs that are near count, tiles are multiplied in single precision, and what may be near is worked out again in double.
Where only the places of known stories are asked for, a task counts what comes before them, up to k, and returns numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.best import ROWS, Best
from engram.sources.stage_tables import materialize, together

#: Queries in one block, and numbers in their vectors: 32 MB.
BLOCK, NUMBERS = 32_768, 1 << 22
#: Vectors that travel to the driver in one row.
PACK = 2048
#: Stories in one slice: with a tile of queries, 4 MB of scores.
SLICE = 512
#: Products that agree to this digit are ties, since equal vectors may differ in the last bits by their place in a matrix.
DIGITS = 12


def _packed(queries: DataFrame, scope: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Query ids, vectors and scopes of PACK queries at most, in order of partitions."""
    columns = [F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")]
    kind = queries.schema[scope].dataType.simpleString() if scope else "int"
    rows = queries.filter(F.col("vector").isNotNull()).select(*columns, F.col(scope).alias("scope") if scope else F.lit(None).cast("int").alias("scope"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PACK):
                part = frame.iloc[at : at + PACK]
                vectors = np.stack([np.asarray(v, float) for v in part["vector"]])
                scopes = part["scope"].astype(object).where(part["scope"].notna(), None).tolist()
                yield pd.DataFrame({"ids": [part["query_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "scopes": [scopes]})

    for r in rows.mapInPandas(pack, f"ids binary, vectors binary, scopes array<{kind}>").toLocalIterator():
        ids = np.frombuffer(r["ids"], np.int64)
        yield ids, np.frombuffer(r["vectors"], float).reshape(len(ids), -1), r["scopes"]


def _blocks(queries: DataFrame, scope: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Blocks of query ids, vectors and scopes, streamed through the driver one after another."""
    held: list[tuple[np.ndarray, np.ndarray, list]] = []
    n = 0
    for ids, vectors, scopes in _packed(queries, scope):
        size = min(BLOCK, max(1, NUMBERS // max(vectors.shape[1], 1)))
        while len(ids):
            room = size - n
            held.append((ids[:room], vectors[:room], scopes[:room]))
            n += len(held[-1][0])
            ids, vectors, scopes = ids[room:], vectors[room:], scopes[room:]
            if n == size:
                yield _joined(held)
                held, n = [], 0
    if n:
        yield _joined(held)


def _joined(parts: list[tuple[np.ndarray, np.ndarray, list]]) -> tuple[np.ndarray, np.ndarray, list]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [s for p in parts for s in p[2]]


def _exact(matrix: np.ndarray, vectors: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Products in double precision of the pairs q, s of a tile: pair by pair, or of the whole tile where they are many."""
    if 8 * len(q) > len(matrix) * len(vectors):
        return (matrix @ vectors.T)[q, s]
    return np.concatenate([np.einsum("ij,ij->i", matrix[q[i : i + 4096]], vectors[s[i : i + 4096]]) for i in range(0, len(q), 4096)])


class _Near:
    """The pairs of a block of queries and a slice of stories whose product is `least` or more, tile by tile.

    Single precision rules out all pairs but those that may be near, by a bound on its error; products of these are
    worked out in double precision.
    """

    def __init__(self, matrix: np.ndarray, least: float):
        self.matrix, self.least = matrix, least
        self.single = matrix.astype(np.float32)
        self.length = np.linalg.norm(matrix, axis=1).max(initial=0.0)

    def pairs(self, vectors: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place of the query, place of the story and product; tiles whose number is in `skip` are passed over."""
        single = np.ascontiguousarray(vectors.T, dtype=np.float32)
        error = (vectors.shape[1] + 4) * 2.0**-23 * self.length * np.linalg.norm(vectors, axis=1).max(initial=0.0)
        for at in range(0, len(self.matrix), ROWS):
            if skip is not None and skip[at // ROWS]:
                continue
            hit = self.single[at : at + ROWS] @ single >= np.float32(self.least - error - 1e-6)
            if not hit.any():
                continue
            q, s = np.divmod(np.flatnonzero(hit), hit.shape[1])
            score = _exact(self.matrix[at : at + ROWS], vectors, q, s)
            keep = score >= self.least
            yield at + q[keep], s[keep], score[keep]


class _Ahead:
    """How many stories come before a known one, for each query of a block: higher scores (rounded to `digits`) first, then
    smaller ids. A query whose story has k before it is open no more."""

    def __init__(self, matrix: np.ndarray, story: np.ndarray, steps: np.ndarray, k: int, digits: int):
        self.matrix, self.single, self.story, self.steps, self.k, self.scale = matrix, matrix.astype(np.float32), story, steps, k, 10.0**digits
        self.least = (steps - 0.5) / self.scale - 10.0**-DIGITS
        self.length = np.linalg.norm(matrix, axis=1).max(initial=0.0)
        self.n, self.open = np.zeros(len(matrix), np.int64), np.arange(len(matrix))

    def count(self, story: np.ndarray, fields: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """fields: of each field which of the stories have it, and the vectors, of length 1 or 0."""
        singles = [np.ascontiguousarray(vectors.T, dtype=np.float32) for _, vectors in fields]
        error = (self.matrix.shape[1] + 4) * 2.0**-23 * self.length + 1e-6
        for at in range(0, len(self.open), ROWS):
            own = self.open[at : at + ROWS]
            score = None
            for (has, _), single in zip(fields, singles, strict=True):
                product = self.single[own] @ single
                if not has.all():
                    product[:, ~has] = -np.inf
                score = product if score is None else np.maximum(score, product, out=score)
            found = np.flatnonzero(score >= (self.least[own] - error).astype(np.float32)[:, None])
            if not len(found):
                continue
            q, s = np.divmod(found, len(story))
            score = np.max([np.where(has[s], _exact(self.matrix[own], vectors, q, s), -np.inf) for has, vectors in fields], axis=0)
            steps = np.rint(np.round(score, DIGITS) * self.scale)
            before = (steps > self.steps[own[q]]) | ((steps == self.steps[own[q]]) & (story[s] < self.story[own[q]]))
            self.n[own] += np.bincount(q[before], minlength=len(own))
        self.open = self.open[self.n[self.open] < self.k]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that scores of a block and a slice take a bounded part of memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def vector_topk(queries: DataFrame, stories: DataFrame, k: int, unit: bool = True, scope: str | None = None, exclude_self: bool = False, least: float | None = None) -> DataFrame:
    """query_id, story_id, similarity, rank: the k best stories of every query.

    unit: vectors have length 1 and similarity is max(0, 1 - d*d/2); else it is the cosine, and vectors of length 0 are
    passed over. scope: a column of both tables that must be equal, applied before the choice. Ties go to the smaller
    story_id; similarity is rounded to 4 digits after the choice. Null vectors match nothing. least: of those, the rows
    whose similarity is `least` or more; for unit vectors without scope.
    """
    if least is not None and (not unit or scope or exclude_self or least <= 0):
        raise ValueError("least is above 0, for unit vectors, without scope and exclude_self")
    read = stories.filter(F.col("embedding").isNotNull()).select(F.col("story_id").cast("long").alias("story_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col(scope).alias("scope") if scope else F.lit(0).alias("scope"))
    schema = "query_id long, story_id long, score double"

    def part(ids: np.ndarray, matrix: np.ndarray, scopes: list) -> DataFrame:
        norms = np.linalg.norm(matrix, axis=1)
        if not unit:
            ids, matrix, scopes = ids[norms > 0], matrix[norms > 0] / norms[norms > 0, None], [s for s, n in zip(scopes, norms, strict=True) if n > 0]
        numbers = {s: i for i, s in enumerate(dict.fromkeys(scopes))}
        own = np.array([numbers[s] for s in scopes], np.int64)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Best(len(ids), k, DIGITS, np.finfo(float).min)
            near = _Near(matrix, least - 1e-4) if least is not None else None
            for batch in _slices(batches):
                story = batch.column(0).to_numpy()
                vector = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                if near:
                    for q, s, score in near.pairs(vector):
                        top.offer_pairs(q, np.round(score, DIGITS), story[s])
                    continue
                length = np.linalg.norm(vector, axis=1)
                if not unit:
                    vector = vector / np.where(length > 0, length, 1)[:, None]
                if scope:
                    theirs = np.array([numbers.get(s, -1) for s in batch.column(2).to_pylist()], np.int64)
                for at in range(0, len(ids), ROWS):
                    scores = matrix[at : at + ROWS] @ vector.T
                    if not unit:
                        scores[:, length == 0] = -np.inf
                    if scope:
                        scores[own[at : at + ROWS, None] != theirs[None, :]] = -np.inf
                    if exclude_self:
                        scores[ids[at : at + ROWS, None] == story[None, :]] = -np.inf
                    top.offer(at, scores, story)
            yield top.rows(ids)

        return read.mapInArrow(best, schema)

    found = together(queries.sparkSession, (part(*block) for block in _blocks(queries, scope)), schema, "best")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "story_id"))
    similarity = F.round(F.greatest(F.lit(0.0), F.col("score")) if unit else F.col("score"), 4)
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "story_id", similarity.alias("similarity"), "rank")
    return best if least is None else best.filter(F.col("similarity") >= least)


def multi_vector_topk(queries: DataFrame, stories: DataFrame, fields: Sequence[str], k: int, digits: int = 6) -> DataFrame:
    """query_id, story_id, similarity, rank: the k best stories of every query, each by the nearest of its vectors.

    stories: story_id and a unit vector per field, null where a story has none; a story without any matches nothing. The
    best field is taken where the row is read, so that one number per story and query is left, however many fields there
    are. Order: similarity rounded to `digits`, then the smaller story_id.
    """
    vectors = [F.col(f).cast("array<double>").alias(f) for f in fields]
    read = stories.filter(reduce(or_, (F.col(f).isNotNull() for f in fields))).select(F.col("story_id").cast("long").alias("story_id"), *vectors)
    schema = "query_id long, story_id long, similarity double"

    def part(ids: np.ndarray, matrix: np.ndarray, _: list) -> DataFrame:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Best(len(ids), k, digits, np.finfo(float).min)
            for batch in _slices(batches):
                story = batch.column(0).to_numpy()
                parts = [(has, column.flatten().to_numpy().reshape(len(has), -1).T) for column in batch.columns[1:] if len(has := np.flatnonzero(np.asarray(column.is_valid())))]
                for at in range(0, len(ids), ROWS):
                    scores = None
                    for has, vectors in parts:
                        product = matrix[at : at + ROWS] @ vectors
                        if scores is None and len(has) == len(story):
                            scores = product
                            continue
                        if scores is None:
                            scores = np.full((len(product), len(story)), -np.inf)
                        scores[:, has] = np.maximum(scores[:, has], product)
                    if scores is not None:
                        top.offer(at, scores, story)
            yield top.rows(ids, score="similarity")

        return read.mapInArrow(best, schema)

    found = together(queries.sparkSession, (part(*block) for block in _blocks(queries, None)), schema, "best-of-fields")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "story_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column have a vector, and the vectors scaled to length 1; those without are of zeros."""
    has = np.asarray(column.is_valid())
    held = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    vectors = np.zeros((len(has), len(held) // max(1, has.sum())))
    vectors[has] = held.reshape(has.sum(), -1)
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return length > 0, vectors / np.where(length > 0, length, 1.0)[:, None]


def steps(similarity: Column, digits: int = 6) -> Column:
    """A similarity rounded to `digits`, as a whole number of the last of them."""
    return F.bround(F.bround(similarity, DIGITS) * 10.0**digits).cast("long")


def known_ranks(pairs: DataFrame, stories: DataFrame, fields: Sequence[str], k: int, digits: int = 6) -> DataFrame:
    """query_id, story_id, rank: the places of known stories among all, in the order of multi_vector_topk, where they are k
    at most.

    pairs: query_id, story_id, vector (of length 1) and similarity, that of the nearest of the story's fields. stories:
    story_id and a vector per field, scaled to length 1 where it is read, null where a story has none. What comes before a
    story is counted, not gathered: a task counts up to k and then asks no more, and returns a number for a pair. Pairs
    of the same vector and story are one, and of those of one vector only the k best are asked for, since all others have
    these before them.
    """
    same = pairs.filter("similarity is not null").groupBy("vector", F.col("story_id").cast("long").alias("story_id"), steps(F.col("similarity"), digits).alias("steps")).agg(F.min("query_id").alias("query_id"), F.collect_set("query_id").alias("all"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.desc("steps"), "story_id"))
    asked = materialize(same.withColumn("place", place).filter(F.col("place") <= k).withColumn("known", F.array("story_id", "steps")), "known")
    read = stories.select(F.col("story_id").cast("long").alias("story_id"), *fields)
    schema = "query_id long, story_id long, n long"

    def part(ids: np.ndarray, matrix: np.ndarray, known: list) -> DataFrame:
        story, own = np.array(known, np.int64).reshape(-1, 2).T

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _Ahead(matrix, story, own, k, digits)
            for batch in _slices(batches):
                count.count(batch.column(0).to_numpy(), [_unit_rows(column) for column in batch.columns[1:]])
            some = count.n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(story[some]), pa.array(np.minimum(count.n[some], k))], names=["query_id", "story_id", "n"])

        return read.mapInArrow(ahead, schema)

    found = together(pairs.sparkSession, (part(*block) for block in _blocks(asked, "known")), schema, "ahead")
    before = found.groupBy("query_id", "story_id").agg(F.sum("n").alias("n"))
    ranked = asked.select("query_id", "story_id", "all").join(before.hint("merge"), ["query_id", "story_id"], "left").withColumn("rank", F.coalesce("n", F.lit(0)) + 1)
    return ranked.filter(F.col("rank") <= k).select(F.explode("all").alias("query_id"), "story_id", "rank")


def vector_pairs(queries: DataFrame, stories: DataFrame, least: float, later: bool = False) -> DataFrame:
    """query_id, story_id, similarity of all pairs of unit vectors that are `least` alike or more, block by block.

    later: only pairs whose story_id is the larger id; where both tables are sorted by id, half of the tiles are passed over.
    """
    read = stories.filter(F.col("embedding").isNotNull()).select(F.col("story_id").cast("long").alias("story_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, story_id long, similarity double"

    def part(ids: np.ndarray, matrix: np.ndarray, _: list) -> DataFrame:
        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            close = _Near(matrix, least - 1e-4)
            first = np.minimum.reduceat(ids, np.arange(0, len(ids), ROWS))
            for batch in _slices(batches):
                story = batch.column(0).to_numpy()
                vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                for q, s, score in close.pairs(vectors, first >= story.max() if later else None):
                    score = np.round(score, 4)
                    keep = (score >= least) & (story[s] > ids[q]) if later else score >= least
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(story[s[keep]]), pa.array(score[keep])], names=["query_id", "story_id", "similarity"])

        return read.mapInArrow(near, schema)

    return together(queries.sparkSession, (part(*block) for block in _blocks(queries, None)), schema, "near")

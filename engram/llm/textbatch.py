"""Arrow and numpy helpers that the text operators share.

Text reaches Python as Arrow buffers, so words are found and hashed on the raw
UTF-8 bytes, a few megabytes at a time, and no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = b"\t\n\x0b\x0c\r "

SPACE_LUT = np.zeros(256, dtype=bool)
SPACE_LUT[list(SPACES)] = True

LOWER_LUT = np.arange(256, dtype=np.uint8)
LOWER_LUT[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def row_key(text: Column) -> Column:
    """Tells apart rows of one doc_id that hold different texts."""
    return F.hash(text)


def named(docs: DataFrame, name: str) -> Column:
    """A column by its name as it is, whatever marks the name holds."""
    return docs["`" + name.replace("`", "``") + "`"]


def rest_struct(docs: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    """The columns to carry along as one struct, `rest`."""
    return [F.struct(*(named(docs, c).alias(c) for c in carry)).alias("rest")] if carry else []


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, row and text, and the columns to carry along as one struct, `rest`; other columns never travel.

    The rows are written once with their number, so that what is found is joined back to its own row: rows without an
    id, and rows that repeat one, stay apart, and copies never meet in one group.
    """
    t = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), t.alias("text"), *rest_struct(docs, carry))
    return materialize(rows, "numbered-rows")


def rest_schema(df: DataFrame) -> str:
    """The part of a schema string that a carried struct takes."""
    if "rest" not in df.columns:
        return ""
    fields = ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in df.schema["rest"].dataType)
    return f", rest struct<{fields}>"


def rest_of(batch: pa.RecordBatch, rows: range) -> tuple[list[pa.Array], list[str]]:
    """The carried struct of a slice's documents, as arrays and names to add to a result."""
    at = batch.schema.get_field_index("rest")
    return ([batch.column(at).slice(rows.start, len(rows))], ["rest"]) if at >= 0 else ([], [])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers of hashes don't cancel."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n or more."""
    old = _TABLES.get(base)
    if old is None or len(old[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        old = _TABLES[base] = (out[0], out[1])
    return old


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i, whatever the place."""
    up, down = _powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Slice:
    """Some whole documents of a batch: rows first..last, their bytes and offsets."""

    def __init__(self, rows: range, data: np.ndarray, off: np.ndarray):
        self.rows, self.data, self.off = rows, data, off

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and per document the index of its first word (one more at the end)."""
        word = ~SPACE_LUT[self.data] if inside is None else inside[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = self.off[1:-1]
        edge = edge[(edge > 0) & (edge < len(word))]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return polynomial(_BYTE[self.data], starts, ends, 0x2545F4914F6CDD1D)


def window_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word sequence words[starts[i]:ends[i]]."""
    return polynomial(words, starts, ends, 0x5851F42D4C957F2D)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """A string column in slices; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield Slice(range(at, to), data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its place in the group."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """mapInArrow, one call of work per batch; tables are cut into batches again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in work(batch):
                if isinstance(out, pa.Table):
                    yield from out.to_batches(max_chunksize=1 << 16)
                else:
                    yield out

    return df.mapInArrow(run, schema)


def take(column: pa.Array, rows: range, owner: np.ndarray) -> pa.Array:
    """Values of a column for rows that came out of a slice, by their document in it."""
    return column.slice(rows.start, len(rows)).take(pa.array(owner))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

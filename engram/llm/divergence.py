"""Source divergence audit by chunk factorization.

White space never stands inside a term, so a text is first cut into white-space chunks, which are counted per document
inside the tasks. Every globally distinct chunk is then tokenised once, and what its terms are is joined back to the counts.
How many documents hold a term lies between the most that hold one of its chunks and the sum over its chunks, which rules
out nearly all terms. Only chunks of the terms that are left are counted by source, each for all of its terms, so that a
task sends on counts of terms; only where the bound of `min_docs` lies between the two does it count documents too, which
it holds whole. A word of all documents never stands in one group of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import LOWER_LUT, SPACE_LUT, map_batches, slices, spread

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The bytes of which terms consist: all of a character's bytes or none.
_TERM_LUT = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are counted together before they are emitted.
_SLICE = 4 << 20
#: Counts that a task gathers from its slices before it adds them up and sends them on.
_HELD = 1 << 21
#: The most frequent chunks, which no task takes for rare ones; the list is sent to every task.
_COMMON, _COMMON_BYTES = 4096, 64
#: Bits that a wanted chunk has in the map that is sent to the tasks, and the map's largest size (32 MB).
_BITS_EACH, _MOST_BITS = 32, 1 << 28
#: Cells (source and term) of one block of terms, and sources of one tile.
_BLOCK, _TILE = 20_000, 128
#: Groups up to this number are sent to every task.
_SENT = 100_000
_SCALE, _ADD = 1_000_000_000, 5


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _chunks(column: pa.Array) -> Iterator[tuple[range, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of documents: its rows, its distinct chunks, and document, chunk and count of every pair that occurs."""
    for part in slices(column, _SLICE):
        starts, ends, first = part.words()
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(part.data[~SPACE_LUT[part.data]]))
        coded = words.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        owner = np.repeat(np.arange(len(part.rows)), np.diff(first))
        pair, n = np.unique(owner * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        yield part.rows, coded.dictionary, pair // size, pair % size, n


class _Tally:
    """Counts by group and item (chunk or term) over the slices of one task, a column for each of `values`. Groups are tuples
    of strings, which are numbered."""

    def __init__(self, names: tuple[str, ...], item: str, values: tuple[str, ...]):
        self.names, self.item, self.values = names, item, values
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def groups(self, batch: pa.RecordBatch) -> np.ndarray:
        """The number of the group of every row of a batch."""
        coded = [batch.column(name).dictionary_encode() for name in self.names]
        code = np.zeros(batch.num_rows, np.int64)
        for c in coded:
            code = code * max(len(c.dictionary), 1) + c.indices.to_numpy()
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        keys = zip(*(batch.column(name).take(pa.array(first)).to_pylist() for name in self.names), strict=True)
        return np.array([self.numbers.setdefault(k, len(self.numbers)) for k in keys], np.int64)[back]

    def add(self, items: pa.Array, code: np.ndarray, group: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        used, code = np.unique(code, return_inverse=True)
        code, group, n = _summed(code, group, n, len(used))
        self.parts.append((items.take(pa.array(used)), code.astype(np.int32), group.astype(np.int32), n))
        self.rows += len(self.parts[-1][1])
        if self.rows >= _HELD:
            yield from self.emit()

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), items) for items, code, _, _ in self.parts]).unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        group, n = (np.concatenate([p[i] for p in self.parts]) for i in (2, 3))
        items = coded.chunk(0).dictionary
        self.parts, self.rows = [], 0
        del coded
        code, group, n = _summed(code, group, n, len(items))
        of = [pa.array([k[i] for k in self.numbers], pa.string()) for i in range(len(self.names))]
        for at in range(0, len(code), 1 << 16):  # strings of one batch at a time
            own, its = pa.array(group[at : at + (1 << 16)]), pa.array(code[at : at + (1 << 16)])
            columns = {name: keys.take(own) for name, keys in zip(self.names, of, strict=True)}
            yield pa.record_batch({**columns, self.item: items.take(its).cast(pa.string()), **{v: np.ascontiguousarray(x[at : at + (1 << 16)]) for v, x in zip(self.values, n.T, strict=True)}})
        del items, code, group, n, of
        pa.default_memory_pool().release_unused()


def _summed(code: np.ndarray, group: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of group and item once, with the sums of its counts (a row of n for each pair)."""
    key = group.astype(np.int64) * size + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[lead] % max(size, 1), key[lead] // max(size, 1), np.add.reduceat(n[order], lead, axis=0) if len(lead) else n


def _documents_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally(("lang",), "chunk", ("docs",))
    for batch in batches:
        group = tally.groups(batch)
        for rows, chunks, owner, code, _ in _chunks(batch.column("text")):
            yield from tally.add(chunks, code, group[rows.start : rows.stop][owner], np.ones((len(owner), 1), np.int64))
    yield from tally.emit()


def chunk_terms(docs: DataFrame) -> DataFrame:
    """chunk, terms (in order, repeats included) and langs (lang and docs, the documents that hold the chunk): a row per
    distinct chunk. What a task has counted goes straight to where its chunk is gathered and tokenised."""
    counted = docs.select("lang", "text").mapInArrow(_documents_of_chunks, "lang string, chunk string, docs long").repartition("chunk")
    summed = counted.groupBy("chunk", "lang").agg(F.sum("docs").alias("docs"))
    found = F.regexp_extract_all(F.translate("chunk", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return summed.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs")).select("chunk", found.alias("terms"), "langs")


def _hashes(column: pa.Array) -> np.ndarray:
    parts = [part.word_hashes(part.off[:-1], part.off[1:]) for part in slices(column)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class ChunkMap:
    """A bit for the hash of every wanted chunk: false means that a chunk isn't wanted, true that it may be."""

    def __init__(self, chunks: DataFrame):
        wanted = chunks.count() * _BITS_EACH
        self.bits = min(_MOST_BITS, 1 << max(16, wanted.bit_length()))
        bits = self.bits

        def work(batch: pa.RecordBatch) -> Iterator[pa.Table]:
            at = np.unique(_hashes(batch.column("chunk")) & np.uint64(bits - 1))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            lead = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            yield pa.table({"word": word[lead].astype(np.int64), "bits": (np.bitwise_or.reduceat(bit, lead) if len(lead) else bit).view(np.int64)})

        held = map_batches(chunks.select("chunk"), work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _terms(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some chunks, the number of each term in order of chunks, and where every chunk's begin."""
    codes, first, terms = np.zeros(0, np.int64), np.zeros(len(chunks) + 1, np.int64), pa.array([], pa.large_string())
    for part in slices(chunks, 1 << 62):
        starts, ends, first = part.words(_TERM_LUT)
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER_LUT[part.data[_TERM_LUT[part.data]]])).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return terms, codes, first


def _counted_again(docs: DataFrame, wanted: ChunkMap, rare: ChunkMap, common: list[str]) -> DataFrame:
    """lang, source, term, n, docs by task: occurrences of the terms of wanted chunks, and how many documents hold them in
    those that are rare. A slice works out the terms of each of its wanted chunks once, whatever the number of its occurrences."""

    usual = pa.array(common, pa.string())

    def terms_of(chunks: pa.Array, owner: np.ndarray, code: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """For a slice: its terms, and term, group and counts of every pair that occurs. of: the group of each document."""
        hashes = _hashes(chunks)
        held = np.flatnonzero(wanted.may_hold(hashes))
        place = np.full(len(chunks), -1)
        place[held] = np.arange(len(held))
        chunks = chunks.take(pa.array(held))
        open_ = rare.may_hold(hashes[held]) & ~pc.is_in(chunks.cast(pa.string()), usual).to_numpy(zero_copy_only=False)
        terms, codes, first = _terms(chunks)
        size = np.diff(first)
        listed = place[code] >= 0
        owner, code = owner[listed], place[code[listed]]

        by_chunk, by_group, n = _summed(code, of[owner], n[listed], len(held))
        at, nth = spread(size[by_chunk])
        term, group, n = codes[first[by_chunk[at]] + nth], by_group[at], n[at]

        owner, code = owner[open_[code]], code[open_[code]]
        at, nth = spread(size[code])
        own = np.unique(owner[at] * max(len(terms), 1) + codes[first[code[at]] + nth])
        counts = np.zeros((len(term) + len(own), 2), np.int64)
        counts[: len(term), 0], counts[len(term) :, 1] = n, 1
        return terms, np.append(term, own % max(len(terms), 1)), np.append(group, of[own // max(len(terms), 1)]), counts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(("lang", "source"), "term", ("n", "docs"))
        for batch in batches:
            group = tally.groups(batch)
            for rows, *pairs in _chunks(batch.column("text")):
                yield from tally.add(*terms_of(*pairs, group[rows.start : rows.stop]))
                del pairs
        yield from tally.emit()

    return docs.select("lang", "source", "text").mapInArrow(work, "lang string, source string, term string, n long, docs long")


def term_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """lang, term of what at least min_docs documents of a language hold; and lang, source, term, n of its occurrences."""
    chunks = materialize(chunk_terms(docs), "chunks")
    flat = chunks.select("chunk", "terms", F.explode("langs").alias("l")).select("l.*", "chunk", "terms")
    bounds = flat.select("lang", "docs", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most"))
    bounds = materialize(bounds.filter(F.col("most") >= min_docs).select("lang", "term", (F.col("least") >= min_docs).alias("sure")), "term-bounds")
    held = flat.select("lang", "chunk", F.explode(F.array_distinct("terms")).alias("term")).join(_hinted(bounds), ["lang", "term"])
    held = materialize(held.groupBy("chunk").agg(F.min("sure").alias("sure")), "term-chunks")
    open_ = held.filter("not sure").select("chunk")

    frequent = flat.filter((F.col("docs") >= min_docs) & (F.octet_length("chunk") <= _COMMON_BYTES)).select("lang", "chunk", "docs")
    common = frequent.orderBy(F.desc("docs"), "lang", "chunk").limit(_COMMON).select("chunk", "lang")
    common = common.join(open_.withColumn("open", F.lit(True)).hint("merge"), "chunk", "left").filter("open is null").select("chunk").distinct()
    counts = _counted_again(docs, ChunkMap(held.select("chunk")), ChunkMap(open_), [r["chunk"] for r in common.collect()])
    counts = counts.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counts.join(_hinted(bounds), ["lang", "term"]), "term-counts")

    exact = counts.filter("not sure").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialize(bounds.filter("sure").select("lang", "term").unionByName(exact.select("lang", "term")), "kept-terms")
    return kept, materialize(counts.join(_hinted(kept), ["lang", "term"]).select("lang", "source", "term", "n"), "cells")


def _share(n: Column, total: Column, size: Column) -> Column:
    """p of a term: exact in integers of any size that can occur."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(_SCALE).cast("decimal(10,0)") * (wide(n) + _ADD), wide(total) + _ADD * wide(size)) + 1


def _hinted(df: DataFrame) -> DataFrame:
    return df.hint("broadcast" if df.count() <= _SENT else "merge")


def _tile(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of one block, for the sources of one tile against those of another."""
    lang, _, one, other = key
    groups = groups.reset_index(drop=True)
    codes, terms = pd.factorize(cells["term"])
    place = pd.Series(groups.index, index=groups["source"])
    p = np.repeat(groups["base"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    p[place[cells["source"]].to_numpy(), codes] = cells["p"].to_numpy(np.int64)
    a, b = (np.flatnonzero(groups["tile"].to_numpy() == t) for t in (one, other))
    left, right = [], []
    for i in a:
        js = b[b > i] if one == other else b
        left.append(np.repeat(i, len(js)))
        right.append(js)
    i, j = np.concatenate(left, dtype=np.int64), np.concatenate(right, dtype=np.int64)
    total = np.array([np.abs(p[x] - p[y]).sum() for x, y in zip(i, j, strict=True)], dtype=np.int64)
    base, source = groups["base"].to_numpy(np.int64), groups["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": source[i], "other": source[j], "total": total, "terms": len(terms), "apart": np.abs(base[i] - base[j])})


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other, value: the distance of every two sources of a language, once for each order.

    A task holds the cells of one block of terms for two tiles of sources; terms that neither source has are worth the
    same in every block and are added at the end.
    """
    blocks = max(1, -(-cells.count() // _BLOCK))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    held = materialize(groups.join(_hinted(tiles), "lang"), "group-tiles")
    meet = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("with")
    sides = [F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two")]
    left = cells.join(_hinted(held.select("lang", "source", "tile", "last")), ["lang", "source"])
    left = left.select("lang", "source", "term", "p", block.alias("block"), "tile", meet).select("lang", "block", *sides, "source", "term", "p")
    right = held.select("lang", "source", "base", "tile", meet).select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), *sides, "source", "base", "tile")
    keys = ("lang", "block", "one", "two")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile, "lang string, source string, other string, total long, terms long, apart long")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("total").alias("total"), F.sum("terms").alias("seen"), F.max("apart").alias("apart"))
    size = groups.groupBy("lang").agg(F.max("size").alias("size"))
    value = (F.col("total") + (F.col("size") - F.col("seen")) * F.col("apart")).alias("value")
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("source").alias("b")))).alias("pair")
    return sums.join(_hinted(size), "lang").select("lang", both, value).select("lang", F.col("pair.a").alias("source"), F.col("pair.b").alias("other"), "value")


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """How far the sources of each language are from one another, and the terms by which each stands out.

    Returns lang, source, part, item, value, rank: part `pair` has a row for every other source of the language, part
    `term` the `top` terms at most that are more frequent in the group than in the language.

    Null text, lang and source are ''. Every row is a document, rows that repeat an id or a text included; ids aren't read.
    Groups without terms have their pairs; a language without kept terms gives 0 for each. Equal values are ranked by item.
    Very long texts and chunks are worked on whole, an empty table gives an empty one, other columns are ignored.
    """
    docs = _documents(docs)
    kept, cells = term_counts(docs, min_docs)

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    groups = docs.select("lang", "source").distinct().join(totals.hint("merge"), ["lang", "source"], "left").join(sizes.hint("merge"), "lang", "left").na.fill(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size"))).otherwise(0)
    groups = groups.select("lang", "source", "total", "size", base.cast("long").alias("base"), F.floor(number / _TILE).cast("int").alias("tile"))
    groups = materialize(groups, "groups")

    shares = cells.join(_hinted(groups.select("lang", "source", "total", "size")), ["lang", "source"])
    shares = materialize(shares.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("size")).cast("long").alias("p")), "shares")
    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("size").alias("size"))
    whole = whole.join(_hinted(langs), "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("size")).cast("long").alias("q"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.join(whole.hint("merge"), ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    pairs = source_pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(over)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occur AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occur GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), sizes AS (
  SELECT lang, count(*) AS size FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS n FROM occur JOIN kept USING (lang, term) GROUP BY ALL
), grp AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * size) AS p
  FROM cells JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * size) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - w.q FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q
)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""

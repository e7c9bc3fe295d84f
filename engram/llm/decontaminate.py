"""Benchmark decontamination by a distributed positional inverted index.

The terms of the benchmark are counted over the corpus. Every window of an item is looked for by its rarest terms: only
for those are postings kept, as a table of term, document and positions. A posting less the place of its term in an
item gives the place where the item would start, so lists intersect by an equality of document, item and start.
What meets all rarest terms of a window is read word by word in the document: the exact matches. What meets two of them
within the slack, and isn't exact, is read as well: the proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import LOWER_LUT, Slice, map_batches, numbered, rest_of, rest_schema, slices, spread, take, window_hashes

WINDOW = 10
#: Rarest terms of a window that are looked for; words by which a term of a proximity match may be off its place, and
#: terms that such a match may lack. With three terms looked for and one lacking, two are left to meet.
RAREST = 3
SLACK = 2
LACKING = 1
#: Words of a document in which postings meet.
CELL = 64
#: Benchmark words that are sent to every task at once; a larger benchmark is worked on in parts of this many words, and
#: an item of more than CHUNK words in chunks that overlap by a window less one word.
MOST_WORDS = 2_000_000
CHUNK = 100_000
#: Fixed: what a word is, in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes that are part of a word: digits, letters in lower case, and all beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _lower(part: Slice) -> Slice:
    return Slice(part.rows, LOWER_LUT[part.data], part.off)


class Items:
    """A benchmark in words: hashes of the words of all items, one after another."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        hashes, sizes = [], []
        for part in slices(pa.array(texts, pa.string())):
            part = _lower(part)
            starts, ends, first = part.words(INSIDE)
            hashes.append(part.word_hashes(starts, ends))
            sizes.append(np.diff(first))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.terms = np.unique(self.words)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first word and number of words of every window; a shorter item is one window."""
        count = np.where(self.size >= length, self.size - length + 1, (self.size > 0).astype(np.int64))
        item = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        return item, self.begin[item] + inner, np.minimum(self.size[item], length)


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """n, the number of occurrences in the corpus, for each of the benchmark's terms (by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in slices(batch.column(2)):
                part = _lower(part)
                starts, ends, _ = part.words(INSIDE)
                words = part.word_hashes(starts, ends)
                at = np.searchsorted(terms, words).clip(max=len(terms) - 1)
                total += np.bincount(at[terms[at] == words], minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    return docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """The index: term, doc_id, row and the term's positions in that document, for the wanted terms."""
    chosen = terms[wanted]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(2)):
            part = _lower(part)
            starts, ends, first = part.words(INSIDE)
            words = part.word_hashes(starts, ends)
            at = np.searchsorted(chosen, words).clip(max=len(chosen) - 1)
            hit = np.flatnonzero(chosen[at] == words)
            owner = np.searchsorted(first, hit, side="right") - 1
            order = np.lexsort((hit, at[hit], owner))
            hit, owner, term = hit[order], owner[order], wanted[at[hit]][order]
            new = np.ones(len(hit), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
            lead = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(lead, len(hit)).astype(np.int32)), pa.array((hit - first[owner]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(term[lead].astype(np.int32)), take(batch.column(0), part.rows, owner[lead]), take(batch.column(1), part.rows, owner[lead]), lists], names=["term", "doc_id", "row", "positions"])

    return map_batches(docs, work, "term int, doc_id long, row long, positions array<int>")


def plan(items: Items, counts: np.ndarray, length: int, rarest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window its item, first word, length, the places of its rarest terms that the corpus has (-1 where it
    has fewer), and how many of its words the corpus lacks."""
    item, at, size = items.windows(length)
    rank = counts[np.searchsorted(items.terms, items.words)] if len(items.words) else np.zeros(0, np.int64)
    rank = np.where(rank > 0, rank, np.iinfo(np.int64).max)
    places, absent = np.full((len(at), rarest), -1, np.int64), np.zeros(len(at), np.int64)
    for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        own = rank[a : a + n]
        absent[i] = (own == np.iinfo(np.int64).max).sum()
        order = np.argsort(own, kind="stable")[: min(rarest, n - absent[i])]
        places[i, : len(order)] = a + order
    return item, at, size, places, absent


#: What is found of a window in a document, with all that reading it takes: the exact ones by the hash of their words,
#: the near ones by the words.
EXACT = "array<struct<start:int,size:int,hash:long,id:string>>"
NEAR = "array<struct<start:int,id:string,words:array<long>>>"


def matches(docs: DataFrame, items: Items, length: int = WINDOW, rarest: int = RAREST, slack: int = SLACK) -> DataFrame:
    """doc_id, row, exact, near: the windows that the index leaves to be read, a row or more per document with any."""
    counts = np.zeros(max(1, len(items.terms)), np.int64)
    for row in term_counts(docs, items.terms).collect() if len(items.terms) else []:
        counts[row["term"]] = row["n"]
    item, at, size, places, absent = plan(items, counts, length, rarest)
    term_of = np.searchsorted(items.terms, items.words)
    full = (places >= 0).sum(1)
    # a window with a term that the corpus lacks can't occur; with more than a near match may lack, not nearly either
    need_exact = np.where(absent == 0, full, rarest + 1)
    need_near = np.where((size > 2) & (absent <= LACKING) & (full >= 2), 2, rarest + 1)
    need = np.minimum(need_exact, need_near)
    live = need <= rarest
    used = np.unique(places[live][places[live] >= 0])
    wanted = np.unique(term_of[used])
    schema = f"doc_id long, row long, exact {EXACT}, near {NEAR}"
    if not len(wanted):
        return docs.sparkSession.createDataFrame([], schema)
    index = materialize(postings(docs, items.terms, wanted), "postings")
    order = np.argsort(term_of[used], kind="stable")
    by_term, term_at = used[order], np.searchsorted(term_of[used][order], np.arange(len(items.terms) + 1))
    item_of = np.searchsorted(items.begin, np.arange(len(items.words)), side="right") - 1
    # windows by the places that they are looked for by, and what an item's easiest window needs
    flat = np.flatnonzero((places.ravel() >= 0) & np.repeat(live, rarest))
    flat = flat[np.argsort(places.ravel()[flat], kind="stable")]
    window_at, windows_by_place = np.searchsorted(places.ravel()[flat], np.arange(len(items.words) + 1)), flat // rarest
    fewest = np.full(max(1, len(items.size)), rarest + 1)
    np.minimum.at(fewest, item, need)
    hashes = window_hashes(items.words, at, at + size)

    def shift(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Offset-adjusted lists: each posting, less each place of its term in an item.

        Starts are dealt into cells of CELL words; those at the end of a cell go to the next one as well, so that what
        belongs together within the slack meets in a cell.
        """
        term = batch.column(0).to_numpy()
        lists = batch.column(3)
        flat = lists.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(term)), np.asarray(lists.value_lengths(), np.int64))
        low, high = term_at[term[row]], term_at[term[row] + 1]
        owner, inner = spread(high - low)
        place = by_term[low[owner] + inner]
        start = flat[owner] - (place - items.begin[item_of[place]])
        again = np.flatnonzero(start % CELL >= CELL - 2 * slack)
        owner, place, start, cell = (np.concatenate([x, y]) for x, y in ((owner, owner[again]), (place, place[again]), (start, start[again]), (start // CELL, start[again] // CELL + 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).take(pa.array(row[owner])), batch.column(2).take(pa.array(row[owner])), *(pa.array(x.astype(np.int32)) for x in (item_of[place], cell, start, place, fewest[item_of[place]]))],
            names=["doc_id", "row", "item", "cell", "start", "place", "need"],
        )

    shifted = map_batches(index, shift, "doc_id long, row long, item int, cell int, start int, place int, need int")
    # lists of one item meet in a cell of a document; a cell holds no more than its words' postings
    met = shifted.groupBy("doc_id", "row", "item", "cell").agg(F.collect_list(F.struct("start", "place")).alias("hits"), F.max("need").alias("need"))
    met = met.filter(F.size("hits") >= F.col("need")).filter(F.size(F.array_distinct("hits.place")) >= F.col("need")).select("doc_id", "row", "hits")

    def intersect(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The windows of a cell whose terms agree on a start, or two of whose terms do within the slack."""
        lists = batch.column(2)
        hit = lists.flatten()
        start, place = hit.field("start").to_numpy().astype(np.int64), hit.field("place").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths(), np.int64))
        owner, inner = spread(window_at[place + 1] - window_at[place])
        window = windows_by_place[window_at[place[owner]] + inner]
        row, start, place = row[owner], start[owner] + at[window] - items.begin[item[window]], place[owner]
        order = np.lexsort((place, start, window, row))
        row, window, start, place = row[order], window[order], start[order], place[order]
        if not len(row):
            return
        # exact: as many different places on one start as are looked for
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (start[1:] != start[:-1])
        other = new.copy()
        other[1:] |= place[1:] != place[:-1]
        lead = np.flatnonzero(new)
        agree = np.add.reduceat(other.astype(np.int64), lead)
        e = lead[agree == need_exact[window[lead]]]
        # near: neighbours in the order of starts, no farther apart than twice the slack, from different places
        close = (row[1:] == row[:-1]) & (window[1:] == window[:-1]) & (start[1:] - start[:-1] <= 2 * slack) & (place[1:] != place[:-1])
        close &= need_near[window[1:]] <= rarest
        n = np.flatnonzero(close)
        n = n[np.append(True, (row[n][1:] != row[n][:-1]) | (window[n][1:] != window[n][:-1]) | (start[n][1:] != start[n][:-1]))] if len(n) else n
        docs_, ids = np.concatenate([row[e], row[n]]), np.array(items.ids, object)
        exact = [[{"start": s, "size": k, "hash": h, "id": i}] for s, k, h, i in zip(start[e].tolist(), size[window[e]].tolist(), hashes[window[e]].view(np.int64).tolist(), ids[item[window[e]]], strict=True)]
        near = [[{"start": s, "id": i, "words": items.words[a : a + k].view(np.int64).tolist()}] for s, i, a, k in zip(start[n].tolist(), ids[item[window[n]]], at[window[n]].tolist(), size[window[n]].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs_)), batch.column(1).take(pa.array(docs_)), pa.array([*exact, *([] for _ in n)], EXACT_TYPE), pa.array([*([] for _ in e), *near], NEAR_TYPE)],
            names=["doc_id", "row", "exact", "near"],
        )

    return map_batches(met, intersect, schema)


EXACT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("id", pa.string())]))
NEAR_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("id", pa.string()), ("words", pa.list_(pa.int64()))]))


def near_starts(words: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, wanted: np.ndarray, size: np.ndarray, slack: int, lacking: int) -> np.ndarray:
    """Whether a proximity match lies within the slack of each start: all but `lacking` of the wanted words (a row each,
    the first `size` count) stand within `slack` words of their place, in words[low:high]."""
    out = np.zeros(len(start), bool)
    reach = np.arange(-2 * slack, 2 * slack + 1)
    for i in range(0, len(start), 1 << 14):
        part = slice(i, i + (1 << 14))
        column = np.arange(wanted.shape[1])
        at = start[part, None, None] + column[None, :, None] + reach[None, None, :]
        inside = (at >= low[part, None, None]) & (at < high[part, None, None])
        same = inside & (words[np.where(inside, at, 0)] == wanted[part, :, None])
        counts = column[None, :] < size[part, None]
        for d in range(2 * slack + 1):
            held = same[:, :, d : d + 2 * slack + 1].any(2) & counts
            out[part] |= held.sum(1) >= size[part] - lacking
    return out


def parts_of(benchmark: DataFrame, length: int = WINDOW, most: int = MOST_WORDS, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """part, item_id, text of the benchmark, no part of more than `most` words; and the number of parts. Items that repeat
    count once, items without words go, and long ones are cut into chunks that share a window less one word."""
    text = F.translate(benchmark["text"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("words")).filter("size(words) > 0")
    cut = F.when(F.size("words") <= chunk, F.array("words")).otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - length, F.lit(chunk - length + 1)), lambda i: F.slice("words", i + 1, chunk)))
    pieces = words.select("item_id", F.explode(cut).alias("words")).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("text")).distinct()
    pieces, parts = materialize(pieces, "benchmark"), 1
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
        largest = dealt.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if (largest or 0) <= max(most, chunk):
            return dealt.select("part", "item_id", "text"), parts
        parts *= 2


def read_items(part: DataFrame) -> Items:
    """A part of the benchmark, of MOST_WORDS words at most, on the driver."""
    rows = part.select("item_id", "text").orderBy("item_id", "text").collect()
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def _read(batch: pa.RecordBatch, slack: int) -> Iterator[pa.RecordBatch]:
    columns = {n: batch.column(n) for n in ("doc_id", "text", "exact", "near")}
    for part in slices(columns["text"]):
        whole, part = part, _lower(part)
        starts, ends, first = part.words(INSIDE)
        words, n = part.word_hashes(starts, ends), len(part.rows)

        def listed(name: str) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
            lists = columns[name].slice(whole.rows.start, n)
            flat = lists.flatten()
            owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            return owner, flat, first[owner] + flat.field("start").to_numpy().astype(np.int64)

        owner, flat, start = listed("exact")
        size, hashes = flat.field("size").to_numpy().astype(np.int64), flat.field("hash").to_numpy().view(np.uint64)
        right = (start >= first[owner]) & (start + size <= first[1:][owner])
        right[right] = window_hashes(words, start[right], (start + size)[right]) == hashes[right]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start[right], 1)
        np.add.at(change, (start + size)[right], -1)
        hit = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])[first])
        ids: list[set] = [set() for _ in range(n)]
        for k in np.flatnonzero(right).tolist():
            ids[owner[k]].add(flat.field("id")[k].as_py())
        owner, flat, start = listed("near")
        near: list[set] = [set() for _ in range(n)]
        if len(owner):
            lists = flat.field("words")
            size = np.asarray(lists.value_lengths(), np.int64)
            row, place = spread(size)
            wanted = np.zeros((len(size), int(size.max())), np.uint64)
            wanted[row, place] = lists.flatten().to_numpy().view(np.uint64)
            for k in np.flatnonzero(near_starts(words, first[owner], first[1:][owner], start, wanted, size, slack, LACKING)).tolist():
                near[owner[k]].add(flat.field("id")[k].as_py())
        rest, names_of_rest = rest_of(batch, whole.rows)
        own = [sorted(i - {None}) for i in ids]
        others = [sorted(k - i - {None}) for k, i in zip(near, ids, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [take(columns["doc_id"], whole.rows, np.arange(n)), take(columns["text"], whole.rows, np.arange(n)), pa.array(np.diff(first)), pa.array(hit), pa.array(own, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string())), pa.array(hit > 0), *rest],
            names=["doc_id", "text", "n_words", "n_hit", "item_ids", "near_item_ids", "contaminated", *names_of_rest],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, carry: tuple[str, ...] = (), slack: int = SLACK, most: int = MOST_WORDS, chunk: int = CHUNK) -> DataFrame:
    """Exact phrase and proximity matches of benchmark items in every document.

    Returns doc_id, text, n_words, n_hit (words inside an occurrence of a window), item_ids (of the items with occurring
    windows, sorted as strings), near_item_ids (of items that match nearly only: all but one of a window's words, three or
    more, stand within `slack` words of their place), contaminated, and the columns to carry along in a struct `rest`.
    Null and empty texts have no words and match nothing; such items have no window. Rows that repeat are judged each;
    items that repeat count once. Terms that are equally rare are taken in the item's order. A null doc_id is like any
    other value; an item without id is left out of item_ids but its windows count as hits. Very long texts are read whole.
    An empty benchmark leaves everything clean, and one of more than `most` words is worked on in parts. Columns other
    than the keys and texts are ignored.
    """
    docs = numbered(docs, carry)
    dealt, parts = parts_of(benchmark, length, most, chunk)
    plain = docs.select("doc_id", "row", "text")
    found = [matches(plain, read_items(dealt.filter(F.col("part") == i)), length, slack=slack) for i in range(parts)]
    found = found[0] if parts == 1 else reduce(DataFrame.unionByName, [materialize(f, "part-matches") for f in found])
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    found = materialize(found.groupBy("row").agg(flat("exact"), flat("near")), "index-matches")
    met = docs.join(found.hint("merge"), "row", "left").drop("row")
    return map_batches(met, lambda batch: _read(batch, slack), "doc_id long, text string, n_words long, n_hit long, item_ids array<string>, near_item_ids array<string>, contaminated boolean" + rest_schema(docs))


def decontaminate_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The row per document that the query reports."""
    out = decontaminate(docs, benchmark)
    digest = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near_item_ids").cast("long").alias("n_near_items"))

"""Quality rules on tokeniser fertility.

Public vocabularies measure every text: characters per token and token entropy by a byte-level vocabulary, and the
share of byte-fallback pieces by a vocabulary that has them. A text outside the bands of its language, or else of its
script, is rejected, as is one that fails the base rules on length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import vocab
from engram.llm.textbatch import rest_of, rest_schema, rest_struct, slices, window_hashes

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: First bytes of the code points that count for characters per token: ASCII letters and digits, and all beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True

#: Scripts by the first code points of their blocks: a letter belongs to the last one that starts at or before it.
SCRIPT_STARTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "other"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other")]


#: Entropy counts against this many bits, or what the number of tokens allows if that is less: natural text of any length
#: comes near a share of it, while the share of log2 of the tokens falls with the length.
ENTROPY_BITS = 8.0


@dataclass(frozen=True)
class Band:
    """Accepted ranges, ends included: letters and digits per token (marks make tokens, but no text), share of
    byte-fallback pieces, and token entropy against ENTROPY_BITS."""

    chars_per_token: tuple[float, float] = (0.8, 12.0)
    byte_share: tuple[float, float] = (0.0, 0.5)
    entropy: tuple[float, float] = (0.5, 1.5)


@dataclass(frozen=True)
class Rules:
    """Bands by language code, by script, and for the rest. Few tokens measure a text less well: every bound gives way by
    `give` over the square root of their number."""

    languages: dict[str, Band] = field(default_factory=dict)
    scripts: dict[str, Band] = field(default_factory=dict)
    rest: Band = Band()
    give: float = 0.3


#: Production bands: lower bounds stand just under the measures of the rows that are labelled as good in the given tables.
#: Text that is laced with marks, set in capitals or laid out as tables falls under the first; text of few different words
#: under that of entropy; text in scripts that the piece vocabulary lacks, symbols and broken encodings over that of byte
#: pieces. Scripts that a vocabulary knows less well are allowed fewer letters and more bytes.
RULES = Rules(
    languages={
        "en": Band((1.82, 8.0), (0.0, 0.1), (0.735, 1.5)),
        "de": Band((1.70, 8.0), (0.0, 0.1), (0.725, 1.5)),
        "fr": Band((1.57, 8.0), (0.0, 0.1), (0.715, 1.5)),
        "es": Band((1.52, 8.0), (0.0, 0.1), (0.695, 1.5)),
    },
    scripts={
        "Latin": Band((1.3, 8.0), (0.0, 0.15), (0.6, 1.5)),
        "Greek": Band((0.4, 4.0), (0.0, 0.9), (0.5, 1.5)),
        "Cyrillic": Band((0.4, 6.0), (0.0, 0.9), (0.5, 1.5)),
        "Han": Band((0.2, 3.0), (0.0, 0.95), (0.5, 1.5)),
    },
)


class WordMeasures:
    """Token ids of a word by one vocabulary, and the number of pieces and of byte pieces by the other."""

    def __init__(self, ranks: str, pieces: str):
        self.ids = vocab.ChunkIds(ranks)
        self.pieces = vocab.pieces(pieces)
        self.bytes = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        known = self.known
        new = [w for w in words if w not in known]
        ids = self.pieces.encode(new, num_threads=1) if new else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        byte_sums = np.diff(np.concatenate([[0], np.cumsum(self.bytes[flat])])[np.concatenate([[0], np.cumsum(sizes)])])
        # both counts in one number: a word has fewer than 2**31 pieces
        fresh = dict(zip(new, (sizes << 31 | byte_sums).tolist(), strict=True))
        if len(known) < vocab.CACHE_CHUNKS:
            known |= fresh
            fresh = known
        counts = np.fromiter((fresh[w] if w in fresh else known[w] for w in words), np.int64, len(words))
        return self.ids.of([" " + w for w in words]), counts >> 31, counts & ((1 << 31) - 1)


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _scripts(part, docs: int) -> list[str]:
    """The script of most letters of each document: code points of words, by block."""
    plain = np.zeros(256, bool)
    plain[[*range(65, 91), *range(97, 123)]] = True
    latin = _per_doc(plain[part.data], part.off)
    places = np.flatnonzero(part.data >= 0xC0)
    b = np.zeros((4, len(places)), np.int64)
    for i in range(4):
        inside = places + i < len(part.data)
        b[i, inside] = part.data[places[inside] + i]
    cont = b & 0x3F
    point = np.select([b[0] < 0xE0, b[0] < 0xF0], [((b[0] & 0x1F) << 6) | cont[1], ((b[0] & 0x0F) << 12) | (cont[1] << 6) | cont[2]], ((b[0] & 7) << 18) | (cont[1] << 12) | (cont[2] << 6) | cont[3])
    letter = point >= 0xC0
    owner = np.searchsorted(part.off, places[letter], side="right") - 1
    starts = np.array([s for s, _ in SCRIPT_STARTS])
    block = np.searchsorted(starts, point[letter], side="right") - 1
    names = sorted({n for _, n in SCRIPT_STARTS})
    number = np.array([names.index(n) for _, n in SCRIPT_STARTS])[block]
    table = np.bincount(owner * len(names) + number, minlength=docs * len(names)).reshape(docs, len(names))
    table[:, names.index("Latin")] += latin
    return [names[i] if n else "none" for i, n in zip(table.argmax(1), table.max(1), strict=True)]


def measure(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and fertility measures of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    script, n_tokens, chars_per_token, byte_share, entropy, and, if there are columns to carry along, these in a struct
    `rest`, and text."""
    ranks, pieces = ranks or vocab.default_path("byte_bpe_50k.tiktoken"), pieces or vocab.default_path("piece_bpe_32k.model")
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, entropy double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = WordMeasures(ranks, pieces)
        for batch in batches:
            for part in slices(batch.column(1)):
                n = len(part.rows)
                starts, ends, first = part.words()
                n_words = np.diff(first)
                doc = np.repeat(np.arange(n), n_words)
                lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80, dtype=np.int64)])
                chars = np.bincount(doc, lead[ends] - lead[starts], minlength=n).astype(np.int64)
                letters = _per_doc(_LETTER[part.data], part.off)
                # lines: cut after each \n and at documents' ends; the \n itself is no part of its line
                newline = np.flatnonzero(part.data == 10)
                line_at = np.sort(np.concatenate([part.off[:-1], newline + 1]))
                line_end = np.sort(np.concatenate([part.off[1:], newline]))
                line_doc = np.searchsorted(part.off, line_at, side="right") - 1
                if n and len(line_at):
                    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(part.off, newline, side="right") - 1]))
                worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_at)
                line_hash = part.word_hashes(line_at, line_end)
                lines = np.unique(np.stack([line_doc[worded].astype(np.uint64), line_hash[worded]]), axis=1)
                dup_lines = np.bincount(line_doc[worded], minlength=n) - np.bincount(lines[0].astype(np.int64), minlength=n)
                # five-word windows that come again in the same document
                words = part.word_hashes(starts, ends)
                at = np.arange(len(words))
                at = at[at + 5 <= first[1:][doc]] if len(words) else at
                again = at[_repeated(window_hashes(words, at, at + 5) + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))]
                change = np.zeros(len(words) + 6, np.int64)
                np.add.at(change, again, 1)
                np.add.at(change, again + 5, -1)
                repeat = np.bincount(doc, np.cumsum(change)[: len(words)] > 0, minlength=n).astype(np.int64)
                # fertility, by distinct word
                edges = np.empty(2 * len(starts) + 1, np.int64)
                edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
                chunks, number = vocab.distinct(part.data, edges)
                number = number[::2][: len(starts)]
                used, number = np.unique(number, return_inverse=True)
                ids, n_pieces, n_bytes = measures.of([chunks[i] for i in used])
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
                begin = np.cumsum(size) - size
                count = size[number]
                total = np.cumsum(count)
                source = np.repeat(begin[number] - total + count, count) + np.arange(total[-1] if len(total) else 0)
                token_doc = np.repeat(doc, count)
                tokens = np.bincount(token_doc, minlength=n)
                _, seen = np.unique(token_doc << 20 | flat[source], return_counts=True)
                distinct_doc = _ >> 20
                log_sum = np.bincount(distinct_doc, seen * np.log2(seen), minlength=n)
                some = np.maximum(tokens, 1)
                entropy = np.where(tokens > 1, (np.log2(some) - log_sum / some) / np.minimum(np.log2(np.maximum(tokens, 2)), ENTROPY_BITS), 1.0)
                piece_sum = np.bincount(doc, n_pieces[number], minlength=n)
                byte_share = np.bincount(doc, n_bytes[number], minlength=n) / np.maximum(piece_sum, 1)
                rows = slice(part.rows.start, part.rows.stop)
                rest, names_of_rest = rest_of(batch, part.rows)
                if rest:
                    rest, names_of_rest = [*rest, batch.column(1)[rows]], [*names_of_rest, "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(2)[rows]]
                    + [pa.array(x, pa.int64()) for x in (n_words, chars, _per_doc(_SYMBOL[part.data], part.off), dup_lines, repeat)]
                    + [pa.array(_scripts(part, n), pa.string()), pa.array(tokens, pa.int64())]
                    + [pa.array(x, pa.float64()) for x in (letters / some, byte_share, entropy)]
                    + rest,
                    names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "n_tokens", "chars_per_token", "byte_share", "entropy", *names_of_rest],
                )

    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), lang.alias("lang"), *rest_struct(docs, carry))
    return read.mapInArrow(run, schema + rest_schema(read) + (", text string" if carry else ""))


def within(rules: Rules):
    """True where a measured row is inside the bands of its language, else of its script, else of the rest."""
    give = F.lit(rules.give) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))

    def inside(band: Band):
        out = F.lit(True)
        for name in ("chars_per_token", "byte_share", "entropy"):
            low, high = getattr(band, name)
            out = out & F.col(name).between(F.lit(low) - give, F.lit(high) + give)
        return out

    test = inside(rules.rest)
    for column, bands in (("script", rules.scripts), ("lang", rules.languages)):
        for name, band in bands.items():
            test = F.when(F.col(column).eqNullSafe(F.lit(name)), inside(band)).otherwise(test)
    return test


def quality_rules(docs: DataFrame, rules: Rules = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of every row of doc_id, text and, if there, lang.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, n_tokens,
    chars_per_token, byte_share, entropy, and, if there are columns to carry along, these in a
    struct `rest`, and text. base_failed: fewer than 10 words, or over 20 % of them in five-word windows
    that come again. kept: not base_failed and inside the bands. Null and empty texts have no words and fail; very long
    ones are measured whole. Repeated rows get the same result each; a null doc_id stays null; of scripts with equally
    many letters the first by name counts. Empty tables give empty tables; other columns are ignored.
    """
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = measure(docs, carry=carry).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens", "chars_per_token", "byte_share", "entropy", *(["rest", "text"] if carry else []))

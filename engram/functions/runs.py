"""The terms of many texts at once, and many patterns in them, inside a task: found in the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, beside the last one's.
PIECE = 8 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = 1


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and where the last one ends, in their bytes; nulls are empty."""
    whole = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return (at - at[0] if len(at) else np.zeros(1, np.int64)), held


def pieces(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows at most, and of so few texts in the column that PIECE bytes are passed by the last."""
    if not batch.num_rows:
        return
    at = parts(batch.column(column))[0][:-1] // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        for i in range(begin, end, rows):
            yield batch.slice(i, min(rows, end - i))


def runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct terms of folded texts (text.TERM: runs of a to z, digits and underscores, or of ideographs), and for each place
    that has one its number among them and the number of the text."""
    return runs_of(*parts(texts))


def runs_of(at: np.ndarray, data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same of texts as `parts` gives them."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    if len(lead):
        code = ((data[lead] & 15).astype(np.int32) << 12) | ((data[lead + 1] & 63).astype(np.int32) << 6) | (data[lead + 2] & 63)
        lead = lead[((code >= 0x3400) & (code <= 0x4DBF)) | ((code >= 0x4E00) & (code <= 0x9FFF))]
        for i in range(3):
            kind[lead + i] = 2
    held = kind > 0
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[at] = True
    starts, ends = np.flatnonzero(cut[:-1] & held), np.flatnonzero(cut[1:] & held) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).dictionary_encode()
    _, offsets, terms = coded.dictionary.buffers()
    places = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1].tolist()
    terms = terms.to_pybytes() if terms is not None else b""
    owner = np.searchsorted(at, starts, side="right") - 1
    return [terms[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], coded.indices.to_numpy(zero_copy_only=False), owner


#: Places that are looked at together.
_TOGETHER = 1 << 17


class Patterns:
    """Finds many patterns in many texts. Every window of a text is looked up among the last 8, 4, 3, 2 or 1 bytes of the
    patterns, as their length allows; what is named there is compared by its first bytes and, if long, in full."""

    def __init__(self, patterns: Sequence[bytes]):
        self.patterns, self.sets = patterns, []
        length = np.fromiter(map(len, patterns), np.int64, len(patterns))
        of = np.where(length >= 8, 8, np.where(length >= 4, 4, length))
        for width in (8, 4, 3, 2, 1):
            own = np.flatnonzero(of == width)
            if not len(own):
                continue
            heads, tails = (np.array([int.from_bytes(patterns[i][cut], "little") for i in own], np.uint64) for cut in (slice(width), slice(-width, None)))
            order = np.argsort(tails, kind="stable")
            keys, first = np.unique(tails[order], return_index=True)
            shift = np.uint64(64 - max(10, len(keys).bit_length() + 4))
            marked = np.zeros(1 << (64 - int(shift)), bool)
            marked[self._mixed(keys, shift)] = True
            self.sets.append((width, own[order], heads[order], length[own][order], keys, np.append(first, len(own)), marked, shift))

    @staticmethod
    def _mixed(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift

    def find(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of patterns and of the texts (as `parts` gives them) that hold them, each pair once, in order of texts."""
        n, out = len(self.patterns), [np.zeros(0, np.int64)]
        padded = np.append(data, np.zeros(8, np.uint8))
        windows = np.ndarray(len(data), "<u8", padded, strides=(1,))
        for width, own, heads, length, keys, first, marked, shift in self.sets:
            mask = np.uint64((1 << 8 * width) - 1)
            for begin in range(0, len(data), _TOGETHER):
                value = windows[begin : begin + _TOGETHER] & mask
                hit = np.flatnonzero(marked[self._mixed(value, shift)])
                key = np.minimum(np.searchsorted(keys, value[hit]), len(keys) - 1)
                same = keys[key] == value[hit]
                key, place = key[same], hit[same] + begin
                many = first[key + 1] - first[key]
                named = np.arange(many.sum()) + np.repeat(first[key] - np.cumsum(many) + many, many)
                end = np.repeat(place, many) + width
                start = end - length[named]
                keep = (start >= 0) & (windows[start] & mask == heads[named])
                named, start, end = named[keep], start[keep], end[keep]
                text = np.searchsorted(at, end - 1, side="right") - 1
                keep = start >= at[text]
                for i in np.flatnonzero(keep & (length[named] > 2 * width)).tolist():
                    keep[i] = data[start[i] : end[i]].tobytes() == self.patterns[own[named[i]]]
                out.append(text[keep] * n + own[named[keep]])
        found = np.sort(np.concatenate(out))
        text, pattern = np.divmod(found[np.diff(found, prepend=-1) > 0], max(1, n))
        return pattern, text

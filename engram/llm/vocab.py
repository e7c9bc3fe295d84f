"""Public tokenizer vocabularies, opened once per Python worker and asked one distinct chunk at a time."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa

#: Distinct chunks whose ids a worker keeps; beyond it chunks are encoded again, with the same result.
CACHE_CHUNKS = 120_000

#: Fixed values of the byte-level vocabulary: its end-of-text string and id.
END_TEXT, END_ID = "<|endoftext|>", 50256


@cache
def byte_bpe(path: str):
    """The rank file of a byte-level vocabulary; its ids are those of the tokenizer file of the same name."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: END_ID})


@cache
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_path(name: str) -> str:
    """Where the box keeps a vocabulary file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkIds:
    """Ids of chunks by a byte-level vocabulary, with those of common chunks kept."""

    def __init__(self, path: str):
        self.encoding, self.known = byte_bpe(path), {}

    def of(self, chunks: list[str]) -> list[list[int]]:
        known, out = self.known, []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = self.encoding.encode(chunk, allowed_special={END_TEXT}) if END_TEXT in chunk else self.encoding.encode_ordinary(chunk)
                if len(known) < CACHE_CHUNKS:
                    known[chunk] = ids
            out.append(ids)
        return out


def chunks_of(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Cuts before every single space that stands between other characters, and at documents' ends.

    A byte-level vocabulary of this pattern always starts a piece there, so the ids of a text are those of its
    chunks in turn.
    """
    white = space[data]
    cut = (data[1:-1] == 32) & ~white[:-2] & ~white[2:] if len(data) > 2 else np.zeros(0, bool)
    return np.union1d(off, np.flatnonzero(cut) + 1)


def distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct chunks, and the number of each chunk among them."""
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64)
    column = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data))
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)

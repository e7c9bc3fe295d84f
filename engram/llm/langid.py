"""Language identification by compression: the language whose dictionary makes a text smallest.

A raw-content zstandard dictionary per language is made of passages of a bounded sample of labelled texts. Every text
is coded whole against all of them, in blocks, so that the dictionary counts over the whole of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a language's dictionary, labelled texts it is made of (about, by a hash of the text), and words of a passage.
DICTIONARY_BYTES = 32 << 10
SAMPLE_ROWS = 400
PASSAGE_WORDS = 64
#: Bytes of text coded at once: small, so that a text's own repeats count little against the dictionary.
BLOCK = 2048
#: Relative margin between the two smallest sizes under which `rejected` is set.
MARGIN = 0.01
#: Compression level and shortest match; at lower levels the coder doesn't look for matches as short as words are.
LEVEL, SHORTEST = 7, 3
UNKNOWN = "und"


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(n))


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, words: int = PASSAGE_WORDS) -> dict[str, bytes]:
    """A dictionary per language from text and lang, the language with most labelled texts first.

    A language is learned from about `rows` texts at most, those whose hash is small; texts that repeat count once. Its
    dictionary holds a passage of `words` words in lower case of each, from a place that the hash chooses.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # the upper 53 bits of a hash, as a number from 0 to 1, against the part of a language's rows that is wanted
    part = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    large = {lang: rows / n for lang, n in share.items() if n > rows}
    wanted = F.lit(1.0)
    for lang, least in large.items():
        wanted = F.when(F.col("lang") == lang, F.lit(least)).otherwise(wanted)
    sample = labelled.select("text", "lang").filter(part < wanted)
    listed = sample.select("lang", F.xxhash64("text").alias("hash"), F.split(F.lower(F.trim("text")), r"[\x20\x09-\x0D]+").alias("words"))
    start = F.pmod(F.col("hash"), F.greatest(F.lit(1), F.size("words") - words + 1)).cast("int") + 1
    passages = listed.select("lang", "hash", F.array_join(F.slice("words", start, words), " ").alias("passage")).distinct()
    found: dict[str, bytes] = {}
    for row in passages.orderBy("lang", "hash", "passage").collect():
        known = found.get(row["lang"], b"")
        if len(known) < size:
            found[row["lang"]] = (known + row["passage"].encode() + b"\n")[:size]
    return {lang: found[lang] for lang in sorted(found, key=lambda x: (-share[x], x))}


def blocks_of(text: str) -> list[bytes]:
    """A whole text in lower case, in blocks of bytes."""
    data = text.lower().encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of doc_id, text.

    score is how much smaller the smallest size is than the next one, from 0 (no difference) to 1; rejected marks
    narrow margins. `und`, score 0 and rejected if the text is null, has no letter, or nothing was learned.
    """
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for n in names]
        for batch in batches:
            langs, scores, weak = [], [], []
            for value in batch.column(1):
                lang, score = UNKNOWN, 0.0
                blocks = blocks_of(text) if names and (text := value.as_py()) and any(map(str.isalpha, text)) else []
                if blocks:
                    sizes = np.array([sum(len(coder.compress(b)) for b in blocks) for coder in coders])
                    order = np.argsort(sizes, kind="stable")
                    lang = names[order[0]]
                    score = 1.0 if len(names) == 1 else float(1 - sizes[order[0]] / sizes[order[1]])
                langs.append(lang)
                scores.append(score)
                weak.append(score < margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(weak, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Predict the language of every document, learned from those whose crc32(doc_id) modulo 3 is not 1.

    Returns doc_id, held_out, lang_pred, score, rejected per input row. A null doc_id is learned from and is not held
    out. Ties between languages go to the one with most labelled texts, then by name. Repeated rows each get the same
    result, and count once in what is learned. Null and empty texts and those without a letter are `und`; very long ones
    are coded whole. Without labelled rows every text is `und`. Empty tables give empty tables; columns other than
    doc_id, text and lang are ignored.
    """
    held = F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    known = learn(docs.select("doc_id", "text", "lang").filter(~held))
    out = classify(docs, known)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

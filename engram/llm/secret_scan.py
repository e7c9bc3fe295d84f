"""Secret scans in Spark expressions alone.

Base patterns find assigned values, access keys and hexadecimal runs. On top, candidate strings are cut out of the text,
a window slides over each, and the Shannon entropy of the characters in the window is kept up to date by the counts of
the character that comes in and the one that goes out. What stays above the threshold of its character class becomes a
span, unless the allow-list knows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the entropy scan: unbroken runs of these characters with a digit and a letter in them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, tried in turn: name, what all of a candidate must match, least bits per character in a window.
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Candidates that are never a secret: identifiers in their usual layout, runs of the alphabet, placeholders, paths and names joined by marks.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)(0123456789|abcdefghij|example|placeholder|xxxxxx|changeme)",
    r"^[A-Za-z]*([-_/=+][A-Za-z]*)*$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)


def spans(text: Column, pattern: str, first: Column | None = None) -> Column:
    """start, end (code points, end exclusive) and text of every match, leftmost and not overlapping.

    The text is split at the matches: a match starts where the pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1) if first is None else first
    pieces = F.split(text, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))).alias("out"),
        ),
    )
    return walked["out"]


def _xlogx(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def most_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of a window that slides over the value.

    The counts of the characters in the window are a map that each step changes in two places; the sum of n log2 n
    over the counts follows by the change of those two. A value shorter than the window is one window.
    """
    chars = F.filter(F.split(value, "", -1), lambda c: c != "")
    size = F.least(F.lit(window), F.size(chars))
    head = F.slice(chars, 1, size)
    kinds = F.array_distinct(chars)
    counts = F.transform(kinds, lambda k: F.size(F.filter(head, lambda c: c == k)))
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + _xlogx(n))

    def step(s: Column, i: Column) -> Column:
        out, come = F.array_position(kinds, chars[i - size]).cast("int"), F.array_position(kinds, chars[i]).cast("int")
        moved = F.transform(s["counts"], lambda n, k: n - F.when(k + 1 == out, 1).otherwise(0) + F.when(k + 1 == come, 1).otherwise(0))
        old_out, old_come = F.element_at(s["counts"], out), F.element_at(s["counts"], come)
        change = F.when(out == come, 0.0).otherwise(_xlogx(old_out - 1) - _xlogx(old_out) + _xlogx(old_come + 1) - _xlogx(old_come))
        now = s["sum"] + change
        return F.struct(moved.alias("counts"), now.alias("sum"), F.least(s["low"], now).alias("low"))

    rest = F.when(F.size(chars) > size, F.sequence(size, F.size(chars) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    walked = F.aggregate(rest, F.struct(counts.alias("counts"), total.alias("sum"), total.alias("low")), step)
    return F.log2(size.cast("double")) - walked["low"] / size


def _threshold(value: Column) -> Column:
    out = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(value.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def _allowed(value: Column) -> Column:
    return reduce(lambda a, b: a | b, (value.rlike(p) for p in ALLOWED))


def _joined(items: Column) -> Column:
    ordered = F.array_sort(items)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Secrets of every row: doc_id, base and all, arrays of (start, kind number, end, kind, hit) in order.

    Kinds: assign (the whole assignment, value of 6 characters or more), access, hex, entropy. The entropy scan adds
    spans that no base span covers. Null and empty texts have none. Matches of a kind don't overlap; spans of different
    kinds may. Spans that start together are ordered by kind as listed. Repeated rows give the same result each; a null
    doc_id stays null. Empty tables give empty tables; columns other than doc_id and text are ignored. Very long texts are
    scanned whole.
    """
    text = F.col("text")
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    lower = F.lower(text)
    maybe = reduce(lambda a, b: a | b, (lower.contains(k) for k in KEYWORDS))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = base.select(
        "doc_id",
        "text",
        F.when(maybe, F.regexp_extract_all(text, F.lit(f"({ASSIGN})"), 1)).alias("assigned"),
        F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(f"({ACCESS})"), 1)).alias("accessed"),
        F.regexp_extract_all(text, F.lit(f"({HEX})"), 1).alias("hexed"),
        F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), 1).alias("candidates"),
    )
    some = lambda hits: F.coalesce(F.size(hits), F.lit(0)) > 0
    value = lambda hit: F.length(F.regexp_extract(hit, f"^(?:{ASSIGN})$", 2))
    suspicious = F.filter("candidates", lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"))

    def tagged(hits: Column, number: int, kind: str) -> Column:
        return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit")))

    placed = found.select(
        "doc_id",
        F.when(some("assigned"), F.filter(spans(text, ASSIGN, F.col("assigned")), lambda s: value(s["hit"]) >= 6)).otherwise(none).alias("assign"),
        F.when(some("accessed"), spans(text, ACCESS, F.col("accessed"))).otherwise(none).alias("access"),
        F.when(some("hexed"), spans(text, HEX, F.col("hexed"))).otherwise(none).alias("hex"),
        F.when(some(suspicious), F.filter(spans(text, CANDIDATE, F.col("candidates")), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]"))).otherwise(none).alias("candidate"),
    )
    placed = placed.select("doc_id", "candidate", F.concat(tagged(F.col("assign"), 0, "assign"), tagged(F.col("access"), 1, "access"), tagged(F.col("hex"), 2, "hex")).alias("base"))
    secret = lambda s: (
        ~_allowed(s["hit"])
        & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
        & (most_entropy(s["hit"], window) >= _threshold(s["hit"]))
    )
    return placed.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", tagged(F.filter("candidate", secret), 3, "entropy"))).alias("all"))


def secret_scan_digest(docs: DataFrame) -> DataFrame:
    """The row per document that the query reports."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))

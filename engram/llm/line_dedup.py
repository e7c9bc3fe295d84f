"""Line dedup: hash normalised lines, count distinct documents per hash, drop what is over the threshold, reassemble by place.

Only 16-byte hashes and places are shuffled for the counts; the lines themselves move once, and only to meet the list
of those that go. Every column is a Spark expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize
from engram.llm.textbatch import numbered

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key (of min_chars code points at least) is in min_docs documents or more.

    The largest doc_id that holds a key keeps all its lines of that key. Returns doc_id, text (the lines that are left,
    joined by \\n; null if the input was null), n_lines, n_dropped, for every input row, and the columns to carry along
    in a struct `rest`.

    Null or empty text is one empty line. Rows that repeat a doc_id count as one document for the threshold, and each
    row gets its own result. A null doc_id counts as one document, smaller than any other. Ties can't occur. Empty
    tables give empty tables; other columns are ignored. Very long texts are worked on whole, at a cost in proportion to
    their lines.
    """
    base = numbered(docs, carry)
    lines = base.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("place", "line")).filter(F.length("line") >= min_chars)
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    lines = materialize(lines.select("doc_id", "row", "place", F.unhex(F.md5(F.encode("key", "UTF-8"))).alias("key")), "line-keys")
    per_doc = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    frequent = (
        per_doc.groupBy("key")
        .agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("key", "keeper")
    )
    frequent = materialize(frequent, "frequent-lines")  # so that a line in most documents can be split in the join
    dropped = lines.join(frequent.hint("merge"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("place").alias("dropped"))
    dropped = materialize(dropped, "dropped-lines")
    rest = ["rest"] if carry else []
    cut = base.select("doc_id", "row", F.col("text").isNull().alias("none"), lines_of(F.col("text")).alias("lines"), *rest)
    met = cut.join(dropped.hint("merge"), "row", "left")
    # places that stay are a difference of sets, so that a text of many lines costs its length
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(places, lambda p: F.get("lines", p)))
    return met.select(
        "doc_id",
        F.when(~F.col("none"), F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *rest,
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The row per document that the query reports."""
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, line, place,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.place, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Projections and predicates on stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import context as C
from engram.functions import text as T
from engram.params import DEFAULTS, Params

#: The title of a story that has none, and what joins problem and outcome to an abstract.
UNTITLED, JOINER = "Untitled", "；"


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """story_id, title, abstract, content, keywords of raw payloads (title, abstract, problem, outcome, content, keywords).

    An abstract that isn't given is problem and outcome joined, or else the content; it is bounded. Keywords keep their
    order and lose repeats and blanks.
    """
    joined = F.nullif(F.concat_ws(JOINER, _blank(F.col("problem")), _blank(F.col("outcome"))), F.lit(""))
    abstract = T.cut(F.coalesce(_blank(F.col("abstract")), joined, _blank(F.col("content")), F.lit("")), params.abstract_chars)
    keywords = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.trim(k)), lambda k: F.coalesce(k != "", F.lit(False))))
    return rows.select("story_id", F.coalesce(_blank(F.col("title")), F.lit(UNTITLED)).alias("title"), abstract.alias("abstract"), F.coalesce("content", F.lit("")).alias("content"), keywords.alias("keywords"))


def render_detail(detail: Column) -> Column:
    """A structured detail (problem, actions, outcome, pitfalls) as text, one line per part, actions numbered."""
    actions = F.array_join(F.transform(detail["actions"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    return F.concat_ws("\n", line("problem", detail["problem"]), F.nullif(actions, F.lit("")), line("outcome", detail["outcome"]), line("pitfalls", F.array_join(detail["pitfalls"], "; ")))


def recall_summary(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """summary and truncated: the abstract if there is one, else the content cut."""
    has = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    return rows.withColumn("summary", F.when(has, F.col("abstract")).otherwise(T.cut(F.col("content"), params.summary_chars))).withColumn("truncated", F.when(has, F.col("abstract") != F.col("content")).otherwise(F.length("content") > params.summary_chars))


def embedding_texts(rows: DataFrame) -> DataFrame:
    """story_id, representation, text: what each representation embeds; multi_vector has a row per field with text."""
    part = lambda *cols: F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in cols))
    keywords = F.array_join("keywords", " ")
    listed = F.array(
        F.struct(F.lit("legacy").alias("representation"), part(keywords, F.col("content")).alias("text")),
        F.struct(F.lit("full").alias("representation"), part(F.col("title"), F.col("abstract"), F.col("content")).alias("text")),
        F.struct(F.lit("default").alias("representation"), part(F.col("title"), F.col("abstract")).alias("text")),
        *(F.struct(F.lit(f"multi_vector:{f}").alias("representation"), F.trim(F.col(f)).alias("text")) for f in ("title", "abstract", "content")),
    )
    return rows.select("story_id", F.explode(F.filter(listed, lambda x: F.coalesce(x["text"] != "", F.lit(False)))).alias("x")).select("story_id", "x.*")


def content_hash(representation: Column, text: Column) -> Column:
    """sha256 of what is embedded and how, in one canonical form."""
    return F.sha2(F.encode(F.concat_ws("\n", representation, text), "UTF-8"), 256)


def in_project(environments: Column, remote: Column, fingerprints: Column) -> Column:
    """Whether a story belongs to a project: by a strong remote identity if the story has one, else by any shared identity.

    environments: array of struct(remote_id, repo_fingerprint, path_fingerprint, workspace_id). The predicate goes below
    the ranking, so that other projects take no places.
    """
    strong = F.filter(F.transform(environments, lambda e: e["remote_id"]), lambda r: F.coalesce(F.startswith(r, F.lit("sha256:")), F.lit(False)))
    weak = F.array_compact(F.flatten(F.transform(environments, lambda e: F.array(e["repo_fingerprint"], e["path_fingerprint"], e["workspace_id"]))))
    return F.when(remote.isNotNull() & (F.size(strong) > 0), F.array_contains(strong, remote)).otherwise(F.arrays_overlap(weak, fingerprints))


def applicable(rows: DataFrame, rules: str = "rules", current: str = "current") -> DataFrame:
    """Adds applicability_score and excluded."""
    out = C.applicability(F.col(rules), F.col(current))
    return rows.withColumn("applicability_score", out["score"]).withColumn("excluded", out["excluded"])


def normalize_sources(rows: DataFrame) -> DataFrame:
    """story_id, sources: descriptors without repeats; one without a session takes the only session there is; sessions
    that no descriptor names are added. rows: story_id, sources array<struct<session_id,evidence>>, session_ids array<long>."""
    only = F.when(F.size("session_ids") == 1, F.element_at("session_ids", 1))
    bound = F.array_distinct(F.transform("sources", lambda s: F.struct(F.coalesce(s["session_id"], only).alias("session_id"), s["evidence"].alias("evidence"))))
    missing = F.array_except("session_ids", F.transform(bound, lambda s: s["session_id"]))
    return rows.select("story_id", F.concat(bound, F.transform(missing, lambda i: F.struct(i.alias("session_id"), F.lit(None).cast("string").alias("evidence")))).alias("sources"))


def reaching(rows: DataFrame, key: str, place: str, line: str, cap: int) -> DataFrame:
    """rows with `reaches`, whether a line can be part of the head or tail of its key's transcript, and `chars`, the length
    of all lines joined. Both come from running sums over sorted rows, which spill; null lines don't count."""
    size = F.coalesce(F.length(line) + 1, F.lit(0)).cast("long")
    order = Window.partitionBy(key).orderBy(place, line)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("size", size).withColumns({"before": before, "chars": F.sum("size").over(Window.partitionBy(key).orderBy(place, line).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1})
    after = F.col("chars") + 1 - F.col("before") - F.col("size")
    half = cap // 2
    reaches = F.col(line).isNotNull() & ((F.col("chars") <= cap) | (F.col("before") < half) | (after < half))
    return placed.withColumn("reaches", reaches).drop("size", "before")


def transcript(place: str, line: str, cap: int) -> Column:
    """An aggregate over rows of `reaching`: the lines in order, or head and tail of a long transcript around a mark. No
    more lines are gathered than these hold."""
    lines = F.array_sort(F.collect_list(F.when(F.col("reaches"), F.struct(place, line))))
    joined = F.array_join(F.transform(lines, lambda x: x[line]), "\n")
    half = cap // 2
    return F.when(F.max("chars") > cap, F.concat(F.substring(joined, 1, half), F.lit("\n...\n"), F.right(joined, F.lit(half)))).otherwise(joined)

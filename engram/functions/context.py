"""Column expressions on environments, projects and paths."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Environment fields with the weight of a match and of a conflict.
FIELDS = {"workspace_id": (0.35, 0.08), "runtime_kind": (0.25, 0.25), "os_family": (0.15, 0.18), "arch": (0.10, 0.15), "tool_type": (0.08, 0.03)}
UNKNOWN = ("", "unknown")


def _known(value: Column, field: str) -> Column:
    out = value.isNotNull() & ~value.isin(*UNKNOWN)
    return out & (value != "other") if field == "tool_type" else out


def environment_compare(current: Column, environment: Column) -> Column:
    """struct(score, conflicts) of two environment structs; fields unknown on either side don't count."""
    scores, conflicts = [], []
    for field, (match, conflict) in FIELDS.items():
        a, b = current[field], environment[field]
        both = _known(a, field) & _known(b, field)
        scores.append(F.when(both & (a == b), F.lit(match)).when(both, F.lit(-conflict)).otherwise(F.lit(0.0)))
        conflicts.append(F.when(both & (a != b), F.lit(field)))
    return F.struct(reduce(lambda x, y: x + y, scores).alias("score"), F.array_compact(F.array(*conflicts)).alias("conflicts"))


def environment_rank_score(similarity: Column, environment_score: Column, weight: float) -> Column:
    """A penalty below one step of a rounded similarity, so that the environment only breaks ties."""
    return F.round(F.greatest(F.lit(0.0), similarity - (1 - (environment_score + 1) / 2) * 1e-4 * weight), 8)


def repository_fingerprint(url: Column) -> Column:
    """sha256 of a repository address in one form: lower case, without user, default port, query, fragment and .git."""
    text = F.lower(F.trim(url))
    scp = text.rlike(r"^[^/@]+@[^/:]+:[^/]") & ~text.contains("://")
    plain = F.when(scp, F.regexp_replace(text, r"^[^@]+@([^:]+):", "ssh://$1/")).otherwise(text)
    host = F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    scheme = F.regexp_extract(plain, r"^([a-z][a-z0-9+.-]*)://", 1)
    port = F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?[^/:?#]+:([0-9]+)", 1)
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | ((scheme == "ssh") & (port == "22"))
    path = F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", "")
    place = F.concat(host, F.when((port != "") & ~usual, F.concat(F.lit(":"), port)).otherwise(F.lit("")), path)
    return F.when(host != "", F.concat(F.lit("sha256:"), F.sha2(F.encode(place, "UTF-8"), 256)))


def keyed_hash(value: Column, namespace: str, key: bytes) -> Column:
    """HMAC-SHA256 of namespace and value, in Spark's own hash function; the key comes from the caller."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else hashlib.sha256(key).digest().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    message = F.concat(F.lit(namespace + "\0"), value)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


#: Directory names that say nothing about a project.
GENERIC = (
    "src", "code", "app", "apps", "application", "applications", "project", "projects", "workspace", "workspaces", "work", "home", "users", "usr", "var", "tmp", "temp", "dev", "etc",
    "bin", "lib", "libs", "dist", "build", "out", "node_modules", "packages", "main", "master", "trunk",
)


def cwd_to_query(path: Column) -> Column:
    """The last path segment that names a project (else the last one), with blanks for dashes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    named = F.filter(parts, lambda p: ~F.startswith(p, F.lit(".")) & ~F.lower(p).isin(*GENERIC))
    return F.translate(F.when(F.size(named) > 0, F.element_at(named, -1)).when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(path), "-_", "  ")


def applicability(rules: Column, current: Column) -> Column:
    """struct(score, excluded) of rules against a map of the current context.

    rules: array of struct(kind, conds: array of struct(field, vals)); a rule holds if all its conditions do. One applies
    rule that holds is worth .12; applies rules of which none holds cost .20 and exclude. An excludes rule that holds
    costs .35 and excludes.
    """
    holds = lambda r: (F.size(r["conds"]) > 0) & F.forall(r["conds"], lambda c: F.coalesce(F.array_contains(c["vals"], F.element_at(current, c["field"])), F.lit(False)))
    needs = F.filter(rules, lambda r: r["kind"] == "applies")
    bars = F.filter(rules, lambda r: r["kind"] == "excludes")
    met, barred = F.exists(needs, holds), F.exists(bars, holds)
    none = F.size(needs) == 0
    score = F.when(none, 0.0).when(met, 0.12).otherwise(-0.20) + F.when(barred, -0.35).otherwise(0.0)
    return F.struct(score.alias("score"), ((~none & ~met) | barred).alias("excluded"))

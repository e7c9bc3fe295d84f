"""Context envelopes of any client in one form: every leaf is cleaned by its rule, and tagged with where it comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import context as C

#: What leaves there are, and by which rule each is cleaned.
LEAVES = {
    "tool.type": "tool", "tool.version": "text", "tool.adapter": "text", "tool.adapter_version": "text", "tool.integration_mode": "mode", "tool.installation_id": "id",
    "device.id": "id", "device.os_family": "text", "device.os_version": "text", "device.arch": "text", "device.display_name": "alias",
    "session.id": "id", "session.external_session_hash": "external-session", "session.started_at": "time", "session.locale": "alias",
    "workspace.id": "id", "workspace.repo_fingerprint": "repository", "workspace.path_fingerprint": "workspace-path", "workspace.project_label": "alias", "workspace.cwd_alias": "alias", "workspace.branch": "alias",
    "runtime.kind": "kind", "runtime.remote_host_hash": "remote-host", "runtime.container_id_hash": "container-id", "runtime.shell": "alias", "runtime.versions": "map",
    "captured_at": "time",
}
#: Flat keys that stand for a leaf, and private values that are only taken as hashes.
FLAT = {
    "device_id": "device.id", "agent_installation_id": "tool.installation_id", "workspace_id": "workspace.id", "session_id": "session.id", "external_session_hash": "session.external_session_hash",
    "repo_fingerprint": "workspace.repo_fingerprint", "path_fingerprint": "workspace.path_fingerprint", "remote_host_hash": "runtime.remote_host_hash", "container_id_hash": "runtime.container_id_hash",
}
PRIVATE = {
    "session.external_session_id": "session.external_session_hash", "workspace.repo_url": "workspace.repo_fingerprint", "workspace.cwd": "workspace.path_fingerprint", "workspace.path": "workspace.path_fingerprint",
    "runtime.remote_host": "runtime.remote_host_hash", "runtime.container_id": "runtime.container_id_hash",
}
#: What a leaf may say, and what stands for the rest.
ALLOWED = {
    "tool": (("claude_code", "cursor", "codex", "gemini_cli", "cline", "other"), "other"),
    "mode": (("mcp", "hook", "log_import", "manual"), "manual"),
    "kind": (("local", "ssh", "devcontainer", "ci", "unknown"), "unknown"),
}
PROVENANCE = ("unknown", "detected", "reported", "inferred", "user_confirmed")
GROUPS = ("tool", "device", "session", "workspace", "runtime")


def _schema() -> str:
    named = [*LEAVES, *PRIVATE]
    kind = lambda leaf: "map<string,string>" if LEAVES.get(leaf) == "map" else "string"
    groups = [f"{g}: struct<{', '.join(f'{leaf.split(".", 1)[1]}: {kind(leaf)}' for leaf in named if leaf.startswith(g + '.'))}>" for g in GROUPS]
    return f"struct<{', '.join([*groups, *(f'{key}: string' for key in (*FLAT, 'captured_at')), 'provenance: map<string,string>'])}>"


def identifier(value: Column) -> Column:
    """A UUID in its usual form, whatever the brackets, dashes and capitals; else null."""
    plain = F.lower(F.regexp_replace(value, r"urn:|uuid:|[{}-]", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def named_identifier(namespace: Column, name: Column) -> Column:
    """The name-based UUID (version 5) of a name within a namespace, itself a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return identifier(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def moment(value: Column) -> Column:
    """An ISO time in UTC with Z, micros only where there are some; no zone means UTC; null if it is none."""
    said = F.trim(value)
    form = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{3,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    zoned = F.when(said.rlike(r"(Z|[T ].*[+-]\d{2}:\d{2})$"), said).when(said.rlike("[T ]"), F.concat(said, F.lit("Z"))).otherwise(F.concat(said, F.lit("T00:00:00Z")))
    at = F.to_utc_timestamp(F.try_to_timestamp(F.when(said.rlike(form), zoned)), F.current_timezone())
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def alias(value: Column) -> Column:
    """A short name, never a path: the last segment, odd characters as dashes, 80 at most; null if nothing is left."""
    last = F.regexp_extract(F.regexp_replace(F.replace(F.trim(value), F.lit("\\"), F.lit("/")), "/+$", ""), "([^/]*)$", 1)
    short = F.substring(F.regexp_replace(F.regexp_replace(last, r"(?U)[^\w .@+-]+", "-"), r"^[ .-]+|[ .-]+$", ""), 1, 80)
    return F.when(short != "", short)


def digest(value: Column, otherwise: Column, *algorithms: str) -> Column:
    """A digest of one of these algorithms in small letters; what is no digest is replaced, never kept."""
    given = F.lower(F.trim(value))
    return F.when(given.rlike(f"^({'|'.join(algorithms)}):[0-9a-f]{{64}}$"), given).otherwise(otherwise)


def _clean(value: Column, rule: str, key: bytes) -> Column:
    said = F.when(value != "", value) if rule != "map" else value
    if rule in ALLOWED:
        names, rest = ALLOWED[rule]
        return F.when(value.isin(*names), value).when(value.isNotNull(), F.lit(rest))
    if rule == "repository":
        return digest(said, C.repository_fingerprint(said), "sha256", "hmac-sha256")
    if rule in ("text", "map"):
        return said
    made = {"id": identifier, "time": moment, "alias": alias}.get(rule)
    return made(said) if made else digest(said, F.concat(F.lit("hmac-sha256:"), C.keyed_hash(said, rule, key)), "hmac-sha256")


def normalize(table: DataFrame, raw: str, key: bytes, source: Column | None = None, profile: str | None = None, now: Column | None = None) -> DataFrame:
    """table with its column `raw`, an envelope in JSON, replaced by struct(tool, device, session, workspace, runtime,
    captured_at, provenance).

    A flat key counts before its leaf, a private value before both and only as a hash (keyed by `key`, the repository's
    plain). Keys that are absent or null say nothing. source: a label of the log that tells tool and mode where the
    envelope doesn't. With a profile (a UUID) a workspace without id gets one from its fingerprint. captured_at falls
    back to `now`. A leaf without value is null and its tag `unknown`; other tags are the envelope's own if they are
    known ones, else `reported`. What isn't JSON gives an empty envelope.

    The work goes in steps of one struct each (cleaned, completed, tagged), so that no step repeats another's expressions.
    """
    get = lambda leaf: reduce(lambda c, part: c[part], leaf.split("."), F.col("_said"))
    name = lambda leaf: leaf.replace(".", "_")

    def tagged(names: list[str]) -> Column:
        tag = F.coalesce(*(F.col("_said")["provenance"][n] for n in names), F.lit("reported"))
        return F.when(tag.isin(*PROVENANCE), tag).otherwise(F.lit("reported"))

    values, origins = {}, {}
    for leaf, rule in LEAVES.items():
        value, tag = _clean(get(leaf), rule, key), tagged([leaf])
        more = [(flat, [flat, leaf]) for flat, stands in FLAT.items() if stands == leaf] + [(own, [own]) for own, stands in PRIVATE.items() if stands == leaf]
        for other, names in more:
            given = get(other)
            there = given.isNotNull() & (given != "") if other in PRIVATE else given.isNotNull()
            value, tag = F.when(there, _clean(given, rule, key)).otherwise(value), F.when(there, tagged(names)).otherwise(tag)
        values[leaf], origins[leaf] = value, tag
    path = F.coalesce(F.when(get("workspace.path") != "", get("workspace.path")), F.when(get("workspace.cwd") != "", get("workspace.cwd")))
    label = F.lower(source) if source is not None else F.lit(None).cast("string")
    tool = F.coalesce(*(F.when(F.startswith(label, F.lit(t.split("_")[0])), F.lit(t)) for t in ALLOWED["tool"][0][:-1]))
    said = table.withColumn("_said", F.from_json(raw, _schema()))
    cleaned = said.withColumn("_v", F.struct(*(v.alias(name(leaf)) for leaf, v in values.items()))).withColumn("_o", F.struct(*(o.alias(name(leaf)) for leaf, o in origins.items()))).withColumns({"_path": path, "_tool": tool})

    value, origin = (lambda leaf: F.col("_v")[name(leaf)]), (lambda leaf: F.col("_o")[name(leaf)])
    hashed = F.when(F.col("_path").isNotNull(), value("workspace.path_fingerprint"))
    at = moment(F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    rest = {
        "tool.type": (F.col("_tool"), F.lit("reported")), "tool.integration_mode": (F.when(F.col("_tool").isNotNull(), "log_import"), F.lit("reported")),
        "workspace.repo_fingerprint": (hashed, origin("workspace.path_fingerprint")),
        "workspace.project_label": (alias(F.col("_path")), F.lit("inferred")), "workspace.cwd_alias": (alias(F.col("_path")), F.lit("inferred")), "captured_at": (at, F.lit("detected")),
    }
    if profile is not None:
        rest["workspace.id"] = (named_identifier(F.lit(profile), F.coalesce(value("workspace.repo_fingerprint"), hashed)), F.lit("inferred"))
    full = {leaf: F.coalesce(value(leaf), rest[leaf][0]) if leaf in rest else value(leaf) for leaf in LEAVES}
    full["runtime.versions"] = F.coalesce(full["runtime.versions"], F.create_map().cast("map<string,string>"))
    tags = {leaf: F.when(value(leaf).isNull(), rest[leaf][1]).otherwise(origin(leaf)) if leaf in rest else origin(leaf) for leaf in LEAVES}
    completed = cleaned.withColumn("_f", F.struct(*(v.alias(name(leaf)) for leaf, v in full.items()))).withColumn("_t", F.struct(*(t.alias(name(leaf)) for leaf, t in tags.items())))

    final = lambda leaf: F.col("_f")[name(leaf)]
    empty = lambda leaf: F.size(final(leaf)) == 0 if LEAVES[leaf] == "map" else final(leaf).isNull() | (final(leaf) == "unknown")
    provenance = F.map_from_arrays(F.array(*map(F.lit, LEAVES)), F.array(*(F.when(empty(leaf), "unknown").otherwise(F.col("_t")[name(leaf)]) for leaf in LEAVES)))
    groups = [F.struct(*(final(leaf).alias(leaf.split(".", 1)[1]) for leaf in LEAVES if leaf.startswith(g + "."))).alias(g) for g in GROUPS]
    return completed.withColumn(raw, F.struct(*groups, final("captured_at").alias("captured_at"), provenance.alias("provenance"))).drop("_said", "_v", "_o", "_path", "_tool", "_f", "_t")

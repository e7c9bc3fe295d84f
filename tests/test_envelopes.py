"""Envelopes against what each rule says, and the name-based identifiers against the standard library."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid

from pyspark.sql import functions as F

from engram.operators import envelopes as envelope

KEY, PROFILE = b"k" * 32, "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def normal(spark, *values, **more):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
    return [r["raw"] for r in envelope.normalize(rows, "raw", KEY, now=F.lit("2024-01-02 03:04:05").cast("timestamp"), **more).orderBy("i").collect()]


def hashed(namespace, value):
    return "hmac-sha256:" + hmac.new(KEY, f"{namespace}\0{value}".encode(), hashlib.sha256).hexdigest()


def test_empty_and_broken_envelopes(spark):
    for e in normal(spark, None, "", "no json", {}, "[1]"):
        assert e["captured_at"] == "2024-01-02T03:04:05Z" and e["provenance"]["captured_at"] == "detected"
        assert len(e["provenance"]) == 27 and set(e["provenance"].values()) == {"unknown", "detected"}
        assert e["runtime"]["versions"] == {} and e["tool"]["type"] is None


def test_private_values_never_leave(spark):
    (e,) = normal(spark, {"session": {"external_session_id": "s-1"}, "workspace": {"path": "/home/me/secret/Shop/"}, "runtime": {"remote_host": "h", "container_id": "c", "kind": "moon"}}, profile=PROFILE)
    assert "secret" not in str(e)
    assert e["session"]["external_session_hash"] == hashed("external-session", "s-1")
    assert e["workspace"]["path_fingerprint"] == e["workspace"]["repo_fingerprint"] == hashed("workspace-path", "/home/me/secret/Shop/")
    assert (e["workspace"]["project_label"], e["provenance"]["workspace.project_label"]) == ("Shop", "inferred")
    assert e["runtime"]["remote_host_hash"] == hashed("remote-host", "h") and e["runtime"]["kind"] == "unknown" and e["provenance"]["runtime.kind"] == "unknown"
    assert e["workspace"]["id"] == str(uuid.uuid5(uuid.UUID(PROFILE), e["workspace"]["repo_fingerprint"])) and e["provenance"]["workspace.id"] == "inferred"


def test_flat_keys_and_tags(spark):
    own, other = str(uuid.uuid4()), str(uuid.uuid4())
    e, f = normal(spark, {"device": {"id": own}, "device_id": other.upper(), "provenance": {"device.id": "detected", "tool.type": "made up"}, "tool": {"type": "vim"}}, {"device": {"id": own}, "device_id": "none"}, source=F.lit("codex-cli"))
    assert e["device"]["id"] == other and e["provenance"]["device.id"] == "detected"
    assert e["tool"]["type"] == "other" and e["provenance"]["tool.type"] == "reported"
    assert f["device"]["id"] is None and f["provenance"]["device.id"] == "unknown"
    assert (f["tool"]["type"], f["tool"]["integration_mode"]) == ("codex", "log_import")


def test_times_and_names(spark):
    rows = spark.createDataFrame([("2024-01-01T00:30:00+01:00", "a/b/ c?d .", "2023-12-31T23:30:00Z", "c-d"), ("2024-01-01", "\\x\\", "2024-01-01T00:00:00Z", "x"), ("2024-01-01T01:02:03.5000", "...", "2024-01-01T01:02:03.500000Z", None), ("12:00", "", None, None), (None, None, None, None)], "t string, a string, wt string, wa string")
    for r in rows.select(envelope.moment(F.col("t")).alias("t"), envelope.alias(F.col("a")).alias("a"), "wt", "wa").collect():
        assert (r["t"], r["a"]) == (r["wt"], r["wa"])

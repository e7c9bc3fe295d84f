"""Declared schemas of the tables; nothing is inferred on read."""

from __future__ import annotations

STORY = (
    "story_id long, title string, abstract string, content string, keywords array<string>, embedding array<float>, "
    "parent_id long, access_count long, access_score double, last_accessed timestamp, created_at timestamp, updated_at timestamp, "
    "deleted_at timestamp, archived_at timestamp, embedding_status string, version long"
)
EDGE = (
    "edge_id long, source_id long, target_id long, edge_type string, weight double, observations long, version long, "
    "created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
EVENT = (
    "sequence long, event_id string, entity_type string, entity_id string, base_version long, version long, device_id string, "
    "operation string, payload string, created_at timestamp"
)
SESSION = "source string, raw_content string, problem_desc string, code_snippets string, conclusion string, context string"
MESSAGE_BLOCK = "array<struct<type:string,text:string>>"
#: Fixed value sets that checks compare with.
EDGE_TYPES = ("semantic", "temporal", "causal", "same_environment", "parent_child", "co_recall", "supersedes")
DIRECTED = ("temporal", "causal", "parent_child", "supersedes")
OPERATIONS = ("create", "update", "merge", "split", "delete")
EMBEDDING_STATUSES = ("pending", "ready", "failed", "archived")

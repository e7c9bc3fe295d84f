"""Tables that cut a plan: written once in the shared folder, read back with their true size."""

from engram.sources.stage_tables import materialize

__all__ = ["materialize"]

"""All named queries (importing a plan module registers its queries)."""

from shardloom.plans import chat, corpus, instruct, layout, streams, telemetry, tools  # noqa: F401
from shardloom.plans.registry import QUERIES

__all__ = ["QUERIES"]

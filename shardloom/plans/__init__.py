"""End-to-end jobs and the registry of named queries over the given tables."""

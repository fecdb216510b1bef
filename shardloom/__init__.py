"""shardloom: training-corpus preparation, layout and run telemetry as Spark jobs."""

__version__ = "0.1.0"

"""Structured Streaming forms of the corpus filter and the telemetry rollup."""

"""Structured Streaming forms of ingestion, counter rates, detection and alert cooldown."""

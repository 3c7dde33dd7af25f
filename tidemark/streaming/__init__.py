"""Structured Streaming: the outbox relay and the leased job queue."""

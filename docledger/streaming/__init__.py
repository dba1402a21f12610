"""Structured Streaming: job events, documents as they arrive, and alert conditions."""

"""Live feed as Structured Streaming."""

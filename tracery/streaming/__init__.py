"""The operators as Structured Streaming jobs."""

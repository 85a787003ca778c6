"""Running totals as Structured Streaming queries."""

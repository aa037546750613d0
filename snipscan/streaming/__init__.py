"""The feed: events as JSON lines, in batch and as streams."""

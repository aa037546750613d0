"""Where snippets come from: commands, payloads, files, and the walk over their syntax."""

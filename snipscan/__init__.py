"""Spark-native analysis of Python snippets: what would they do before they run."""

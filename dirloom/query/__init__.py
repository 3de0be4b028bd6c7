"""The query language and its execution."""

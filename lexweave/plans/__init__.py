"""The query language and the plans queries compile to."""

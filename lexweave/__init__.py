"""lexweave: full-text indexing and relevance search expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

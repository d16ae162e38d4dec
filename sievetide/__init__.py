"""Review analytics on Spark: document-review operators as DataFrame transformations."""

__version__ = "0.1.0"

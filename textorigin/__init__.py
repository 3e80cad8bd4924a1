"""Text-origin analytics on Spark: document features, surprise sequences and detector evaluation."""

__version__ = "0.1.0"

"""quillmark: a Spark-native engine for questions about corpora of text and source files."""

__version__ = "0.1.0"

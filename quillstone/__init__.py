"""quillstone: a PySpark-native engine for document analytics and retrieval quality."""

__version__ = "0.3.0"

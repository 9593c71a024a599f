"""Registered queries, a module for each family."""


def load() -> None:
    """Import every module that registers queries."""
    from quillstone.plans import conversation_queries, document_queries, projection_queries, relational_queries, retrieval_queries, source_queries, store_queries, streaming_queries, string_queries  # noqa: F401

"""Incremental indexing of arriving documents."""

from .index_stream import index_new_documents

__all__ = ["index_new_documents"]

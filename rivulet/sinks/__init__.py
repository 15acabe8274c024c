"""Sinks: RSS, Atom, JSON and CSV."""

from rivulet.sinks.documents import document_parts, fragment, json_text
from rivulet.sinks.writers import document_text, write_document, write_records

__all__ = [
    "document_parts",
    "document_text",
    "fragment",
    "json_text",
    "write_document",
    "write_records",
]

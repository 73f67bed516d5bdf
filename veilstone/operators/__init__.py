"""Operators on documents, spans, code books and replies."""

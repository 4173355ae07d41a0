"""User-facing jobs over the given tables, by group."""

from .base import Book


def books() -> list[Book]:
    from . import edit_queries, handoff_queries, projection_queries, reader_queries, stream_queries, summary_queries, text_queries, timeline_queries

    return [timeline_queries.book, text_queries.book, edit_queries.book, stream_queries.book, summary_queries.book, projection_queries.book, reader_queries.book, handoff_queries.book]

"""Relational operators: ingest, reads, search, fusion, evaluation, embedding backlog, jobs."""

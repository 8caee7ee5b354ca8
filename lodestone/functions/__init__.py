"""Scalar functions: text normalisation, locales, tokens, queries, similarity, snippets, chunking, hashes."""

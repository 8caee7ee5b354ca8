"""Stateful processes as Structured Streaming queries."""

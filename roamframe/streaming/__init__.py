"""Graphs from streams of edges."""

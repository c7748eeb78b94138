"""Graphs from tables, example graphs, printed forms."""

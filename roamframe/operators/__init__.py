"""Operators over graphs and routes."""

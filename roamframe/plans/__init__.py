"""Planning helpers and the registry of queries."""

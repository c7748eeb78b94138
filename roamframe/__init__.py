"""roamframe: property-graph traversal and structural analysis on Spark DataFrames."""

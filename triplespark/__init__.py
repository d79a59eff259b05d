"""A triple store and basic-graph-pattern engine on Spark DataFrames."""

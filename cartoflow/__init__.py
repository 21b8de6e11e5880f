"""Map, road-graph and GPS analytics as Spark DataFrames."""

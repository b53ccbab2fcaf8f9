"""spatialq: declarative spatial-measurement queries on Spark DataFrames."""

"""barleaf: daily price-bar panels and their analytics as Spark DataFrames."""

"""sparseloom: graph analytics on Spark DataFrames."""

"""A deductive and corpus analytics engine on Spark DataFrames."""

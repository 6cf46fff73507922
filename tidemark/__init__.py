"""Change-impact analytics and corpus preparation on Spark DataFrames."""

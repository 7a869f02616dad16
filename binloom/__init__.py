"""Genome-bin analytics and corpus preparation on Spark DataFrames."""

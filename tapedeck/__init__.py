"""Listening-history jobs and training-data operators on Spark DataFrames."""

"""Batch credit assessment of small businesses from alternate-data feeds, on Spark DataFrames."""

"""Lodestar: formula discovery, expression analytics and equation solving on Spark DataFrames."""

"""Gridded environmental fields and particle trajectories as Spark DataFrames."""

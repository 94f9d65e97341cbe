"""Rollbook: event, participant and attendance analytics on Spark DataFrames."""

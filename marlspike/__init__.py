"""Outreach analytics, audience, capacity and lead-processing operators on Spark DataFrames."""

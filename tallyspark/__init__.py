"""Batch and incremental jobs for public opinion poll data on Spark."""

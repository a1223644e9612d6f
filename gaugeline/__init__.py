"""Measurement-clustering engine on Spark DataFrames.

Readings arrive in small arrays per inspection record.  The package reads and
flags them, summarises them as clustering features (CF), clusters and scores
them, and reports on readings and devices.  Every operator is a function from
DataFrame to DataFrame.
"""

"""Versioned, log-ordered tables as Spark DataFrames: snapshots, replay, feeds and retention."""

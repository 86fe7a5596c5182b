"""Interval and alignment analytics for long-read genomes on Spark DataFrames."""

"""Readers that turn stored data into DataFrames."""

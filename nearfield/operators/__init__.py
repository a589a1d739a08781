"""Operators over vector DataFrames."""

"""Operators on graph tables: plain functions from DataFrames to DataFrames."""

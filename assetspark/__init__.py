"""Compiled asset catalogs as DataFrames."""

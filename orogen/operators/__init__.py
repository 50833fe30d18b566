"""Terrain operators over DataFrames."""

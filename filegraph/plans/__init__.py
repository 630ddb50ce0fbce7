"""Compilers from declarative specs to DataFrames: step pipelines and graph mappings."""

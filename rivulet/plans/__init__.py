"""The language: scripts to syntax trees, and graphs to DataFrames."""

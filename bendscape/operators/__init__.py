"""Operators from sequences to pieces, curvature, symmetry and calls; each takes and returns DataFrames."""

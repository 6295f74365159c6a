"""Morphology, geometry and corpus analytics on Spark DataFrames."""

"""Hyperspectral unmixing and quantification on Spark."""

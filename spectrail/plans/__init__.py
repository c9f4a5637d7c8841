"""Whole workflows: estimators with a facade, and the catalogue of registered queries with their SQL."""

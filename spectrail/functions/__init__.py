"""Column functions: vectors in array columns, physics and text. All are visible to Catalyst."""

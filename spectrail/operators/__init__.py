"""Operators over tables of pixels: pixels(pixel_id, y, x, block_id, spectrum array<double>) and columns beside it."""

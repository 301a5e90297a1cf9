"""Operators for building training data: terms, rankings, packing, mixing and sentences."""

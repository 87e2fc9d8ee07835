"""Operators on pixel, label, mask, decay and cell tables."""

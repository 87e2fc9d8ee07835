"""Composed jobs over many datasets."""

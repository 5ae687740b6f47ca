"""Whole jobs made of operators: model building, comparison of populations, export."""

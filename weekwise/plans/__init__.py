"""Whole jobs composed of operators: each takes raw or weekly DataFrames and returns one lazy plan."""

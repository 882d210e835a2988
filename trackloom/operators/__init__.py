"""Operators on trajectories: DataFrame in, DataFrame out."""

"""Whole jobs, each reading the stored output of the one before."""

"""Operators over long tables of samples, runs, intervals and test metrics."""

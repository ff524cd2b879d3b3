"""Scalar kernels and column functions."""

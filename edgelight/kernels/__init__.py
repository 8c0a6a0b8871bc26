"""Numerical kernels on numpy arrays; no Spark here."""

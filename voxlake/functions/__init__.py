"""Scalar column functions: NaN-aware arithmetic, interpolation kernels and spline bases."""

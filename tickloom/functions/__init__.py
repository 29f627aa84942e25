"""Column functions and kernels."""

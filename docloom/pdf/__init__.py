"""Kernels over single documents (bytes in, rows out) that the scans and sinks run on executors."""

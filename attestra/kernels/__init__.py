"""NumPy kernels over one clip; no Spark here."""

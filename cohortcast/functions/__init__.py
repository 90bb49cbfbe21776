"""Column-expression function library (numeric helpers, densities, splines, text)."""

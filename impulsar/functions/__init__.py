"""Plain functions: quantiles and kernel weights."""

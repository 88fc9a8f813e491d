"""Row-scale steps of a fit: alignment, samples, absorption, ranks, covariances."""

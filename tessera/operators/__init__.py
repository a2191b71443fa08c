"""DataFrame-in, DataFrame-out operators of record linkage."""

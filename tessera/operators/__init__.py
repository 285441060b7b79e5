"""DataFrame-level operators of the dialect."""

"""Trees over boxes that arrive in micro-batches."""

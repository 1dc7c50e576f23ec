"""Surface-area k-D trees over boxes, and operators for training data, on Spark."""

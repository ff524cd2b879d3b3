"""Step models, frontiers and controllers, in batch and as streams."""

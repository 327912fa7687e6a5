"""DataFrame patterns that need more than one step to stay distributed."""

"""The retail analyses, one module per subject."""

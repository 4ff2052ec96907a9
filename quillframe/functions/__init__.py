"""Column-to-Column functions; stateless, so they also work on streams."""

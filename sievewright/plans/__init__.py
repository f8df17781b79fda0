"""Named queries with their equivalent SQL."""

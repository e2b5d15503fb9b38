"""operators of codestrata."""

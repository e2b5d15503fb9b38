"""streaming of codestrata."""

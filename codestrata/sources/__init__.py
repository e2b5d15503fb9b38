"""sources of codestrata."""

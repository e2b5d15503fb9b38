"""functions of codestrata."""

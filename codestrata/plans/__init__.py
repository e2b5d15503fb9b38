"""plans of codestrata."""

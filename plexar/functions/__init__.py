"""Column functions: vectors, JSON paths, topics, hashes."""

"""Relational operators of the engine (chunking, index preparation, kNN, review)."""

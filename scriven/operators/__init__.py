"""Relational operators over sentences, shingles and scores."""

"""Part of the teaching-corpus engine."""

"""Registered queries; importing the package fills the registry."""

from checks import corpus_queries, deck_queries, score_queries  # noqa: F401

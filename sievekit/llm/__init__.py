"""Operators for preparing training corpora, their queries and the pieces they share."""

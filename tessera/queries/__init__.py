"""Queries of operators that the standard tables can't feed: small literal tables, each also the first part of its SQL."""

"""Predicates, joins, aggregates and the operators composed of them."""

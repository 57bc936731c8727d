"""Predicates and orders as data, and their translation to columns."""

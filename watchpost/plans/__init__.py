"""Queries over the test tables, composed of operators."""

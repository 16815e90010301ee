"""Stateful operators that also run on unbounded input."""

"""Sorted maps and sets, op-log replay, placement models and log-structured tables."""

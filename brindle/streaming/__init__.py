"""Structured Streaming into log-structured tables."""

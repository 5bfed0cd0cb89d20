"""Formats: JSON pairs, tab-separated text, sorted string tables and write-ahead logs."""

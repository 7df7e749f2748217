"""Readers and folds of logs, files and tables."""

"""Readers and writers of graphs and raw files."""

"""Partitioners, clusterers and their measures."""

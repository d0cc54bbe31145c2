"""Clusters' loads from a stream of events."""

"""Readers, sinks and keyed tables."""

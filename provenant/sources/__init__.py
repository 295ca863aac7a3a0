"""Readers, sinks and table helpers."""

"""Readers, sinks and the views that queries start from."""

"""Readers and writers: working trees, object stores, refs."""

"""Readers and writers at the edge."""

"""Readers and writers: project exports, datasets, sessions."""

"""Streams of sequences."""

"""Readers and writers of sequence and track files."""

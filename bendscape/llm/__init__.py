"""Operators for preparing training text at scale: filtering, deduplication, redaction, scoring, mixing and archives."""

"""Scoring of streams and refits by batch."""

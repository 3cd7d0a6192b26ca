"""Structured Streaming forms; each agrees with its batch twin."""

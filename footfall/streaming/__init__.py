"""Structured Streaming jobs: intake, landing, retry."""

"""Structured Streaming: scoring with confidence flags, windowed drift."""

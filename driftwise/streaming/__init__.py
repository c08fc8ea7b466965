"""Structured Streaming forms of the monitoring operators (T-1 ... T-6)."""

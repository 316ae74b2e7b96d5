"""Stateful operators for Structured Streaming."""

"""Structured Streaming forms of tracking and conflict detection."""

"""Streams of events, heartbeats and payloads."""

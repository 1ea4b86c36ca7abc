"""Structured Streaming: live windows and headways (S1, S2), and replay of stored tables as streams."""

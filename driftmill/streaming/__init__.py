"""Structured Streaming: the control chart with state, and windows with watermarks."""

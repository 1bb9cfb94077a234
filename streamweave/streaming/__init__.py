"""Verbs over Structured Streaming."""

from .live import WINDOWED, live, sessions, stateful_steps, stats_by_time  # noqa: F401
